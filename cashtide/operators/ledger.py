"""From double-entry ledger postings to customers, suppliers, invoices, payments
and costs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cashtide.functions.numbers import ddmm_date, document_number, trimmed, trimmed_date, trimmed_decimal
from cashtide.functions.pseudonyms import COMPANY_FORMS, transliterated, with_address, with_shown_name
from cashtide.operators.skew import join_stored
from cashtide.operators.storno import INVOICE_FLAG, ledger_live_invoices, ledger_storno_match
from cashtide.session import materialise

# Account ranges, overhead accounts and terms.
DEBTORS = (10000, 69999)
CREDITORS = (70000, 99999)
BANK_ACCOUNT = "1800"
REVENUE_PREFIX = "4"
MATERIAL_PREFIX = "5"
OVERHEAD_PREFIX = "6"
PERSONNEL_FROM = 5500
OVERHEAD_ACCOUNTS = {
    "6020": "Rent",
    "6070": "Rent",
    "6110": "Rent",
    "6520": "Fuel",
    "6530": "Fuel",
    "6600": "Advertising",
    "6740": "Insurance",
    "6805": "Software License",
    "6830": "Software License",
    "6837": "Software License",
    "6845": "Software License",
    "6850": "Software License",
    "6855": "Software License",
    "5736": "Insurance",
}
OTHER_OVERHEAD = "Software License"
INVOICE_TERM_DAYS = 7
SUPPLIER_TERM_DAYS = 7
NAME_LENGTH = 40
CONTACT = "Kontakt"

REVENUE, CUSTOMER_PAYMENT, EXPENSE, SUPPLIER_PAYMENT, SKIPPED = (
    "revenue",
    "customer_payment",
    "expense",
    "supplier_payment",
    "skipped",
)


def literal_map(values: dict[str, str]) -> Column:
    return F.create_map(*[F.lit(v) for pair in values.items() for v in pair])


def account_class(contra: Column) -> Column:
    """DEB for a customer account, KRED for a supplier account, else GL; ``contra`` is the
    account as a number, null if it is none."""
    return F.when(contra.between(*DEBTORS), "DEB").when(contra.between(*CREDITORS), "KRED").otherwise("GL")


def ledger_account_class(raw: DataFrame) -> DataFrame:
    number = trimmed(F.col("gegenkonto")).try_cast("int")
    return raw.withColumn("_contra", number).withColumn("account_class", account_class(F.col("_contra"))).drop("_contra")


def ledger_date(raw: DataFrame, year: int) -> DataFrame:
    return raw.withColumn("date", ddmm_date(F.col("belegdatum"), year))


def ledger_parse(raw: DataFrame, year: int) -> DataFrame:
    """Typed postings.  An amount that is no number is null and flagged, so one
    bad line does not lose the file.

    Fields are trimmed once, in a step of their own, whatever is then made of them.
    """
    text = {"konto": "konto", "geg": "gegenkonto", "sh": "soll_haben", "doc": "belegfeld1", "text": "buchungstext", "name": "name"}
    fields = {name: trimmed(F.col(source)) for name, source in {**text, "_umsatz": "umsatz", "_day": "belegdatum"}.items()}
    fields["vat"] = trimmed(F.col("vat")) if "vat" in raw.columns else F.lit("")
    typed = raw.select("line", *[field.alias(name) for name, field in fields.items()]).withColumns(
        {"_contra": F.col("geg").try_cast("int"), "amount": trimmed_decimal(F.col("_umsatz"))}
    )
    return typed.select(
        "line",
        *text,
        "vat",
        "amount",
        trimmed_date(F.col("_day"), year).alias("date"),
        account_class(F.col("_contra")).alias("account_class"),
        F.col("amount").isNull().alias("quarantined"),
    )


def ledger_classify(parsed: DataFrame) -> DataFrame:
    """What each posting is, by its account and the party of the contra account."""
    konto, party = F.col("konto"), F.col("account_class")
    bought = konto.startswith(MATERIAL_PREFIX) | konto.startswith(OVERHEAD_PREFIX)
    posting = (
        F.when(konto.startswith(REVENUE_PREFIX) & (party == "DEB"), REVENUE)
        .when((konto == BANK_ACCOUNT) & (party == "DEB"), CUSTOMER_PAYMENT)
        .when(bought & (party == "KRED"), EXPENSE)
        .when((konto == BANK_ACCOUNT) & (party == "KRED"), SUPPLIER_PAYMENT)
        .otherwise(SKIPPED)
    )
    return parsed.withColumn("posting_class", posting)


def ledger_stored(classified: DataFrame) -> DataFrame:
    """Classified postings stored by class: the export is parsed once, and each output reads
    the postings of its own class."""
    return materialise(classified, "posting_class")


def of_class(classified: DataFrame, name: str) -> DataFrame:
    return classified.filter(F.col("posting_class") == name)


def ledger_invoices_out(live: DataFrame, payments: DataFrame) -> DataFrame:
    """Live invoices in the import format; paid if any payment names the document.

    ``project_id`` stays empty: the ledger does not know projects, so a lookup
    has to fill it before the import.
    """
    paid = payments.select("doc").distinct().withColumn("_paid", F.lit(True))
    return (
        join_stored(live, paid, ["doc"], "left")
        .orderBy("date", "doc", "line")
        .select(
            F.col("doc").alias("invoice_number"),
            F.lit("").alias("project_id"),
            F.col("date").alias("invoice_date"),
            F.date_add("date", INVOICE_TERM_DAYS).alias("due_date"),
            "amount",
            F.when(F.col("_paid"), "Paid").otherwise("Issued").alias("status"),
        )
    )


def ledger_payments_out(classified: DataFrame) -> DataFrame:
    return (
        of_class(classified, CUSTOMER_PAYMENT)
        .orderBy("date", "line")
        .select(
            F.col("doc").alias("invoice_number"),
            F.col("geg").alias("debtor_account"),
            F.col("date").alias("payment_date"),
            "amount",
            F.lit("Bank Transfer").alias("payment_method"),
        )
    )


def _with_memo(postings: DataFrame, salt: str | None, keep_names: bool) -> DataFrame:
    """Postings with their text as it may leave the transform.  To be set once they are in order: a
    sort reads its rows twice, first for a sample, and would draw every pseudonym twice."""
    text = F.substring("text", 1, NAME_LENGTH)
    return with_shown_name(postings, "memo", text, F.col("geg"), "company", salt, keep_names)


def ledger_costs_out(
    classified: DataFrame,
    salt: str | None = None,
    keep_names: bool = False,
    overhead_accounts: dict[str, str] = OVERHEAD_ACCOUNTS,
) -> DataFrame:
    """Expenses as direct costs (material and services) or overhead by account."""
    direct = F.col("konto").startswith(MATERIAL_PREFIX) & (F.col("konto").try_cast("int") < PERSONNEL_FROM)
    overhead = F.coalesce(F.try_element_at(literal_map(overhead_accounts), F.col("konto")), F.lit(OTHER_OVERHEAD))
    ordered = of_class(classified, EXPENSE).orderBy("date", "line")
    return _with_memo(ordered, salt, keep_names).select(
        F.col("date").alias("cost_date"),
        "amount",
        F.col("konto").alias("skr04_account"),
        F.when(direct, "Direct Project").otherwise("Operational Overhead").alias("cost_category"),
        F.when(direct, "").otherwise(overhead).alias("overhead_category"),
        F.col("geg").alias("creditor_account"),
        "memo",
    )


def ledger_supplier_payments_out(classified: DataFrame, salt: str | None = None, keep_names: bool = False) -> DataFrame:
    ordered = of_class(classified, SUPPLIER_PAYMENT).orderBy("date", "line")
    return _with_memo(ordered, salt, keep_names).select(
        F.col("geg").alias("creditor_account"),
        F.col("date").alias("payment_date"),
        "amount",
        "memo",
    )


def ledger_debtor_names(classified: DataFrame) -> DataFrame:
    """Per customer account the first name on its invoices, else on its payments,
    else the text of its first payment.  Accounts with none of these are absent."""
    is_payment = F.col("posting_class") == CUSTOMER_PAYMENT
    order = F.struct(is_payment.alias("payment"), F.col("line").alias("line"))
    return (
        classified.filter(F.col("posting_class").isin(REVENUE, CUSTOMER_PAYMENT))
        .groupBy(F.col("geg").alias("debtor_account"))
        .agg(
            F.min_by("name", F.when(F.col("name") != "", order)).alias("named"),
            F.min_by(F.substring("text", 1, NAME_LENGTH), F.when(is_payment, F.col("line"))).alias("first_payment"),
        )
        .select("debtor_account", F.coalesce("named", "first_payment").alias("name"))
        .filter(F.col("name").isNotNull())
    )


def ledger_creditor_names(classified: DataFrame) -> DataFrame:
    """Per supplier account the name, or else the text, of its first expense."""
    label = F.substring(F.when(F.col("name") != "", F.col("name")).otherwise(F.col("text")), 1, NAME_LENGTH)
    return (
        of_class(classified, EXPENSE)
        .groupBy(F.col("geg").alias("creditor_account"))
        .agg(F.min_by(label, "line").alias("name"))
    )


def ledger_customers_out(names: DataFrame, salt: str | None = None, keep_names: bool = False) -> DataFrame:
    """Customer rows with pseudonymous name and address and a derived e-mail."""
    account = F.col("debtor_account")
    words = F.split(F.trim(F.col("shown")), r"\s+")
    is_company = F.lit(False)
    for form in COMPANY_FORMS:
        is_company = is_company | F.contains(F.col("shown"), F.lit(form))
    first = F.when(is_company, CONTACT).otherwise(F.element_at(words, 1))
    last = F.when(is_company, F.element_at(words, 1)).otherwise(F.element_at(words, -1))
    email = F.concat(F.lower("first_name"), F.lit("."), F.lower("last_name"), F.lit("@example.de"))
    return (
        with_shown_name(with_address(names, account), "shown", F.col("name"), account, "person", salt, keep_names)
        .withColumn("first_name", first)
        .withColumn("last_name", last)
        .orderBy("debtor_account")
        .select(
            "debtor_account",
            "first_name",
            "last_name",
            F.when(is_company, F.col("shown")).otherwise("").alias("company_name"),
            transliterated(email).alias("email"),
            "street_name",
            "house_number",
            "postal_code",
            "city",
            F.lit("Germany").alias("country"),
        )
    )


def ledger_suppliers_out(names: DataFrame, salt: str | None = None, keep_names: bool = False) -> DataFrame:
    account = F.col("creditor_account")
    letters = F.substring(F.regexp_replace(F.lower("supplier_name"), "[^a-z]", ""), 1, 14)
    mailbox = F.coalesce(F.nullif(letters, F.lit("")), F.lit("supplier"))
    return (
        with_shown_name(names, "supplier_name", F.col("name"), account, "company", salt, keep_names)
        .orderBy("creditor_account")
        .select(
            "creditor_account",
            "supplier_name",
            F.lit(SUPPLIER_TERM_DAYS).alias("payment_terms_days"),
            F.concat(F.lit("orders@"), mailbox, F.lit(".de")).alias("contact_email"),
        )
    )


def ledger_unmatched_payments(payments: DataFrame, live: DataFrame) -> DataFrame:
    """Documents that were paid in this period but not billed in it."""
    billed = live.select("doc").distinct()
    return payments.select("doc").distinct().join(billed, "doc", "left_anti").orderBy("doc")


REPORT_LINES = [
    "postings",
    "revenue",
    "customer_payments",
    "expenses",
    "supplier_payments",
    "skipped",
    "credit_notes_matched",
    "credit_notes_out_of_period",
    "documents_reversed",
    "live_invoices",
    "gross_revenue",
    "net_revenue",
    "customers",
    "suppliers",
]


def ledger_report(classified: DataFrame, matches: DataFrame, live: DataFrame) -> DataFrame:
    """Counts and totals of a transform, one figure per row."""

    def n(name):
        return F.count_if(F.col("posting_class") == name)

    billed = (F.col("posting_class") == REVENUE) & (F.col("sh") == INVOICE_FLAG)
    names_known = ledger_debtor_names(classified).agg(F.count(F.lit(1)).alias("customers"))
    suppliers = of_class(classified, EXPENSE).agg(F.count_distinct("geg").alias("suppliers"))
    parts = [
        classified.agg(
            F.count(F.lit(1)).alias("postings"),
            n(REVENUE).alias("revenue"),
            n(CUSTOMER_PAYMENT).alias("customer_payments"),
            n(EXPENSE).alias("expenses"),
            n(SUPPLIER_PAYMENT).alias("supplier_payments"),
            n(SKIPPED).alias("skipped"),
            F.sum(F.when(billed, F.col("amount"))).alias("gross_revenue"),
        ),
        matches.agg(
            F.count("invoice_line").alias("credit_notes_matched"),
            F.count_if(F.col("invoice_line").isNull()).alias("credit_notes_out_of_period"),
            F.count_distinct("invoice_doc").alias("documents_reversed"),
        ),
        live.agg(F.count(F.lit(1)).alias("live_invoices"), F.sum("amount").alias("net_revenue")),
        names_known,
        suppliers,
    ]
    rows = None
    for part in parts:
        figures = F.array(
            *[
                F.struct(
                    F.lit(c).alias("metric"), F.coalesce(F.col(c).cast("decimal(22,2)"), F.lit(0)).alias("value")
                )
                for c in part.columns
            ]
        )
        unrolled = part.select(F.inline(figures))
        rows = unrolled if rows is None else rows.unionByName(unrolled)
    place = F.array_position(F.array(*[F.lit(m) for m in REPORT_LINES]), F.col("metric"))
    return rows.withColumn("value", F.col("value").cast("decimal(22,2)")).orderBy(place)


def ledger_storno_messages(matches: DataFrame) -> DataFrame:
    """One sentence per credit note, for the transform report."""
    amount = F.concat(F.lit(" EUR "), F.coalesce(F.format_number(F.col("amount"), 2), F.lit("unreadable")))
    found = F.concat(
        F.lit("storno: credit note "),
        F.col("credit_doc"),
        F.lit(" reverses "),
        F.col("invoice_doc"),
        amount,
        F.lit(" on debtor "),
        F.col("geg"),
    )
    absent = F.concat(
        F.lit("storno: credit note "),
        F.col("credit_doc"),
        amount,
        F.lit(" reverses an invoice billed before this period (debtor "),
        F.col("geg"),
        F.lit(") - excluded from this batch"),
    )
    return matches.withColumn(
        "message", F.when(F.col("invoice_line").isNotNull(), found).otherwise(absent)
    )


def ledger_report_lines(
    report: DataFrame, matches: DataFrame, unmatched: DataFrame, docnum_pattern: str = r"(\d+)"
) -> DataFrame:
    """The transform report as text, one line per row, to be read in the order of the
    sections and of ``place`` within them.

    Credit notes and unmatched documents take a line each, however many there are.
    """
    figures = report.agg(*[F.max(F.when(F.col("metric") == m, F.col("value"))).alias(m) for m in REPORT_LINES])

    def count(name):
        return F.col(name).cast("bigint").cast("string")

    def euros(name):
        return F.format_number(F.col(name), 2)

    def line(section, *parts):
        text = F.concat(*[F.lit(p) if isinstance(p, str) else p for p in parts])
        return F.struct(F.lit(section).alias("section"), F.lit("").alias("place"), text.alias("text"))

    totals = figures.select(
        F.inline(
            F.array(
                line(
                    1, "classified ", count("postings"), " postings: ", count("revenue"), " revenue, ",
                    count("customer_payments"), " customer payments, ", count("expenses"), " expenses, ",
                    count("supplier_payments"), " supplier payments, ", count("skipped"), " internal/GL movements",
                ),
                line(
                    3, count("revenue"), " revenue postings -> ", count("live_invoices"), " live invoices (",
                    count("documents_reversed"), " reversed in-period, ", count("credit_notes_out_of_period"),
                    " credit notes against earlier periods)",
                ),
                line(5, "gross credited revenue EUR ", euros("gross_revenue"), " -> net of storno EUR ", euros("net_revenue")),
                line(
                    6, "customers ", count("customers"), ", suppliers ", count("suppliers"), ", invoices ",
                    count("live_invoices"), ", customer payments ", count("customer_payments"), ", supplier payments ",
                    count("supplier_payments"), ", cost postings ", count("expenses"),
                ),
            )
        )
    )
    length, digits = document_number(F.col("credit_doc"), docnum_pattern)
    place = F.concat_ws("-", F.lpad(length.cast("string"), 6, "0"), digits, F.lpad(F.col("credit_line").cast("string"), 19, "0"))
    credits = ledger_storno_messages(matches.withColumn("place", place)).select(F.lit(2).alias("section"), "place", F.col("message").alias("text"))
    missing = unmatched.select(
        F.lit(4).alias("section"),
        F.col("doc").alias("place"),
        F.concat(F.lit("payment references an invoice not in this period (billed earlier): "), F.col("doc")).alias("text"),
    )
    return totals.unionByName(credits).unionByName(missing).orderBy("section", "place")


def ledger_transform(
    raw: DataFrame, year: int, salt: str | None = None, keep_names: bool = False, docnum_pattern: str = r"(\d+)"
) -> dict[str, DataFrame]:
    """The whole transform: six output tables, and the report as figures and as text."""
    classified = ledger_stored(ledger_classify(ledger_parse(raw, year)))
    revenue, payments = of_class(classified, REVENUE), of_class(classified, CUSTOMER_PAYMENT)
    matches = ledger_storno_match(revenue, docnum_pattern)
    live = ledger_live_invoices(revenue, matches)
    report = ledger_report(classified, matches, live)
    unmatched = ledger_unmatched_payments(payments, live)
    return {
        "customers": ledger_customers_out(ledger_debtor_names(classified), salt, keep_names),
        "suppliers": ledger_suppliers_out(ledger_creditor_names(classified), salt, keep_names),
        "invoices_for_pipeline": ledger_invoices_out(live, payments),
        "payments": ledger_payments_out(classified),
        "costs": ledger_costs_out(classified, salt, keep_names),
        "supplier_payments": ledger_supplier_payments_out(classified, salt, keep_names),
        "report": report,
        "transform_report": ledger_report_lines(report, matches, unmatched, docnum_pattern),
        "unmatched_payments": unmatched,
    }


