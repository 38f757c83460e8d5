"""The same results in ANSI SQL, for an engine that reads the base tables as views.

Every statement is a chain of common table expressions over the shared derivation
blocks, written independently of the operators: other join orders, other windows,
other closed forms.
"""

from __future__ import annotations

from collections.abc import Sequence

from cashtide.functions.pseudonyms import (
    CITIES,
    COMPANY_FORMS,
    COMPANY_TRADES,
    FIRST_NAMES,
    LAST_NAMES,
    POSTAL_CODES,
    STREETS,
)
from cashtide.operators.audit import table_predicates
from cashtide.operators.ledger import OVERHEAD_ACCOUNTS, REPORT_LINES
from cashtide.plans.derived import BASE_TABLES, BLOCKS, LEDGER_YEAR, SALT, placeholders
from cashtide.schemas import TABLES
from cashtide.seeds import _rows

AS_OF = "DATE '1998-06-15'"
LAST = "DATE '1998-07-15'"
RUN_TS = "1998-06-15 12:00:00"
AS_OF_KEY = 19980615


# --- building blocks ---------------------------------------------------------


def _literal(value, kind: str) -> str:
    if value is None:
        return {"percent": "CAST(NULL AS DECIMAL(5,2))"}.get(kind, "NULL")
    if kind == "flag":
        return str(value).lower()
    if kind == "percent":
        return f"CAST({value} AS DECIMAL(5,2))"
    if kind == "int":
        return f"CAST({value} AS INT)"
    return f"'{value}'"


def _domain(name: str) -> str:
    """A reference domain as literal rows."""
    columns = TABLES[name].columns
    return " UNION ALL ".join(
        "SELECT " + ", ".join(f"{_literal(row[c.name], c.kind)} AS {c.name}" for c in columns) for row in _rows()[name]
    )


def _hex(expression: str, digits: int) -> str:
    return f"CAST('0x' || substr(sha256({expression}), 1, {digits}) AS BIGINT)"


SCHEDULE_ID = "project_id * 65536 + " + _hex("milestone_code", 4)


def _chain(s: str, project: str, invoice: str, orders: str, cost: str, before: str | None, again: bool = False) -> dict[str, str]:
    """The rule chain from schedule to daily cash flow over given tables; ``again`` if the
    invoices have codes and links of an earlier run."""
    own = " EXCLUDE (milestone_code)" if again else ""
    code, link = ("i.milestone_code", "coalesce(n.schedule_id, c.schedule_id)") if again else ("NULL", "n.schedule_id")
    unlinked = " EXCLUDE (schedule_id)" if again else ""
    P, I, O, C = (f"{{{n}}}" for n in (project, invoice, orders, cost))
    due = f"{{due{s}}}"
    if before is None:
        schedule = f"SELECT * FROM {due}"
    else:
        B = f"{{{before}}}"
        schedule = f"""
SELECT b.schedule_id, b.project_id, b.milestone_code, b.due_offset_days,
       coalesce(n.expected_amount, b.expected_amount) AS expected_amount, b.status, b.created_by
FROM {B} b LEFT JOIN {due} n ON n.project_id = b.project_id AND n.milestone_code = b.milestone_code
UNION ALL
SELECT n.* FROM {due} n
WHERE NOT EXISTS (SELECT 1 FROM {B} b WHERE n.project_id = b.project_id AND n.milestone_code = b.milestone_code)"""
    return {
        f"due{s}": f"""
SELECT {SCHEDULE_ID} AS schedule_id, project_id, milestone_code, default_due_offset_days AS due_offset_days,
       CAST(round(total_value * percentage * 0.01, 2) AS DECIMAL(12,2)) AS expected_amount,
       'Pending' AS status, 'rule:BR-1' AS created_by
FROM {P} JOIN {{ref_milestone_type}} ON is_milestone AND part_of_split = (total_value >= 3000)""",
        f"schedule{s}": schedule,
        f"coded{s}": f"""
SELECT i.*{own}, CASE WHEN total_value < 3000 THEN 'SINGLE_PAYMENT' WHEN amount < 3000 THEN 'ADJUSTMENT'
  ELSE CASE row_number() OVER (PARTITION BY i.project_id ORDER BY invoice_date, invoice_number)
       WHEN 1 THEN 'STAGE_1_ROOF' WHEN 2 THEN 'STAGE_2_COMMISSIONING' ELSE 'ADJUSTMENT' END END AS milestone_code
FROM {I} i JOIN {P} p ON p.project_id = i.project_id
UNION ALL
SELECT i.*{own}, {code} FROM {I} i WHERE i.project_id NOT IN (SELECT project_id FROM {P})""",
        f"linked{s}": f"""
SELECT c.*{unlinked}, {link} AS schedule_id FROM {{coded{s}}} c
LEFT JOIN {{schedule{s}}} n ON n.project_id = c.project_id AND n.milestone_code = c.milestone_code
      AND n.milestone_code IN (SELECT milestone_code FROM {{ref_milestone_type}} WHERE is_milestone)""",
        f"advanced{s}": f"""
SELECT n.schedule_id, n.project_id, n.milestone_code, n.due_offset_days, n.expected_amount,
       CASE WHEN l.any_paid THEN 'Paid' WHEN n.status = 'Pending' AND l.schedule_id IS NOT NULL THEN 'Invoiced'
            ELSE n.status END AS status, n.created_by
FROM {{schedule{s}}} n LEFT JOIN (
  SELECT schedule_id, bool_or(status = 'Paid') AS any_paid FROM {{linked{s}}} WHERE schedule_id IS NOT NULL GROUP BY schedule_id
) l ON l.schedule_id = n.schedule_id""",
        f"flow_in{s}": f"""
SELECT n.project_id, p.start_date + n.due_offset_days AS forecast_date, n.expected_amount AS expected_cash_in,
       CAST(0 AS DECIMAL(12,2)) AS expected_cash_out, n.expected_amount AS net_cashflow,
       'customer_milestone' AS flow_source, 'rule:BR-3' AS created_by
FROM {{advanced{s}}} n JOIN {P} p ON p.project_id = n.project_id
WHERE n.status IN ('Pending', 'Invoiced', 'Overdue') AND p.start_date + n.due_offset_days BETWEEN {AS_OF} AND {LAST}""",
        f"flow_orders{s}": f"""
SELECT o.project_id, o.order_date + s.payment_terms_days AS forecast_date, CAST(0 AS DECIMAL(12,2)) AS expected_cash_in,
       o.total_amount AS expected_cash_out, CAST(-o.total_amount AS DECIMAL(12,2)) AS net_cashflow,
       'supplier_order' AS flow_source, 'rule:BR-3' AS created_by
FROM {O} o JOIN {{supplier_dim}} s ON s.supplier_id = o.supplier_id
JOIN {{ref_order_status}} r ON r.status_code = o.status
WHERE r.counts_as_payable AND o.order_date + s.payment_terms_days BETWEEN {AS_OF} AND {LAST}""",
        f"flow_overhead{s}": f"""
SELECT CAST(NULL AS BIGINT) AS project_id, c.cost_date AS forecast_date, CAST(0 AS DECIMAL(12,2)) AS expected_cash_in,
       c.amount AS expected_cash_out, CAST(-c.amount AS DECIMAL(12,2)) AS net_cashflow,
       'operational_overhead' AS flow_source, 'rule:BR-3' AS created_by
FROM {C} c JOIN {{operational_cost}} oc ON oc.cost_id = c.cost_id WHERE c.cost_date BETWEEN {AS_OF} AND {LAST}""",
        f"forecast{s}": f"""
SELECT * FROM {{forecast_before}} WHERE forecast_date < {AS_OF}
UNION ALL SELECT * FROM {{flow_in{s}}} UNION ALL SELECT * FROM {{flow_orders{s}}} UNION ALL SELECT * FROM {{flow_overhead{s}}}""",
        f"fact{s}": f"""
SELECT * FROM {{fact_before}} WHERE date_key < {AS_OF_KEY}
UNION ALL
SELECT CAST(strftime(f.forecast_date, '%Y%m%d') AS INT), p.project_id, c.customer_id, NULL,
       CAST(sum(f.expected_cash_in) AS DECIMAL(12,2)), CAST(sum(f.expected_cash_out) AS DECIMAL(12,2)),
       CAST(sum(f.expected_cash_in - f.expected_cash_out) AS DECIMAL(12,2))
FROM {{forecast{s}}} f LEFT JOIN ({P} p LEFT JOIN {{customer_rec}} c ON c.customer_id = p.customer_id) ON p.project_id = f.project_id
WHERE f.forecast_date >= {AS_OF} AND f.flow_source <> 'operational_overhead' GROUP BY ALL
UNION ALL
SELECT CAST(strftime(c.cost_date, '%Y%m%d') AS INT), NULL, NULL, {_hex("'Operational Overhead|' || oc.overhead_category", 15)},
       CAST(0 AS DECIMAL(12,2)), CAST(sum(c.amount) AS DECIMAL(12,2)), CAST(-sum(c.amount) AS DECIMAL(12,2))
FROM {C} c JOIN {{operational_cost}} oc USING (cost_id)
WHERE c.cost_date BETWEEN {AS_OF} AND {LAST} GROUP BY ALL""",
        f"daily{s}": f"""
SELECT full_date, cash_in, cash_out, net_cashflow,
       CAST(sum(net_cashflow) OVER (ORDER BY full_date ROWS UNBOUNDED PRECEDING) AS DECIMAL(32,2)) AS cumulative_position
FROM (
  SELECT d.full_date, CAST(coalesce(sum(f.expected_cash_in), 0) AS DECIMAL(22,2)) AS cash_in,
         CAST(coalesce(sum(f.expected_cash_out), 0) AS DECIMAL(22,2)) AS cash_out,
         CAST(coalesce(sum(f.net_cashflow), 0) AS DECIMAL(22,2)) AS net_cashflow
  FROM (SELECT CAST(unnest(generate_series({AS_OF}, {LAST}, INTERVAL 1 DAY)) AS DATE) AS full_date) d
  LEFT JOIN {{fact{s}}} f ON f.date_key = CAST(strftime(d.full_date, '%Y%m%d') AS INT)
  GROUP BY d.full_date
)""",
        f"kpi{s}": f"""
SELECT CAST(sum(v) FILTER (k = 'owed') AS DECIMAL(32,2)) AS outstanding_receivables,
       CAST(sum(v) FILTER (k = 'due') AS DECIMAL(32,2)) AS supplier_due_7_days,
       CAST(sum(v) FILTER (k = 'net') AS DECIMAL(32,2)) AS projected_30day_net,
       CAST(sum(v) FILTER (k = 'active') AS BIGINT) AS active_projects,
       CAST(sum(v) FILTER (k = 'below') AS BIGINT) AS days_negative_next_30
FROM (
  SELECT 'owed' AS k, CAST(amount AS DECIMAL(32,2)) AS v FROM {I} WHERE status IN ('Issued', 'Partially Paid', 'Overdue')
  UNION ALL
  SELECT 'due', o.total_amount FROM {O} o JOIN {{supplier_dim}} s USING (supplier_id) SEMI JOIN {P} p USING (project_id)
  WHERE o.status <> 'Cancelled' AND o.order_date <= {AS_OF} + 7 - s.payment_terms_days
  UNION ALL SELECT 'net', net_cashflow FROM {{daily{s}}}
  UNION ALL SELECT 'below', CASE WHEN cumulative_position < 0 THEN 1 ELSE 0 END FROM {{daily{s}}}
  UNION ALL SELECT 'active', CASE WHEN status = 'Completed' THEN 0 ELSE 1 END FROM {P}
  UNION ALL SELECT unnest(['owed', 'due', 'net', 'active', 'below']), 0
)""",
    }


DAY = "[0-9][0-9][0-9][0-9]-[0-9][0-9]-[0-9][0-9]"


def _checked(staging: str) -> str:
    """Each check on its own; the first that has something to say gives the reason."""

    def unless(good: str, reason: str) -> str:
        return f"CASE WHEN coalesce({good}, false) THEN NULL ELSE {reason} END"

    checks = [
        unless("trim(raw_invoice_number) <> ''", "'invoice_number is empty'"),
        unless("regexp_full_match(raw_project_id, '[0-9]+') AND pid IS NOT NULL", "'project_id is not a whole number: ' || raw_project_id"),
        unless("pid IN (SELECT project_id FROM {project})", "'project_id ' || raw_project_id || ' does not exist'"),
        unless(f"regexp_full_match(raw_invoice_date, '{DAY}') AND billed IS NOT NULL", "'invoice_date is not YYYY-MM-DD: ' || raw_invoice_date"),
        unless(f"regexp_full_match(raw_due_date, '{DAY}') AND due IS NOT NULL", "'due_date is not YYYY-MM-DD: ' || raw_due_date"),
        unless("due >= billed", "'due_date is before invoice_date'"),
        unless(
            "regexp_full_match(raw_amount, '[0-9]+([.][0-9][0-9]?)?') AND try_cast(raw_amount AS DECIMAL(12,2)) IS NOT NULL",
            "'amount is not a positive decimal: ' || raw_amount",
        ),
        unless("raw_status IN (SELECT status_code FROM {ref_invoice_status})", "'unknown invoice status: ' || raw_status"),
    ]
    return f"""
SELECT * EXCLUDE (pid, billed, due), coalesce({", ".join(checks)}) AS rejection_reason
FROM (SELECT *, try_cast(raw_project_id AS BIGINT) AS pid, try_cast(raw_invoice_date AS DATE) AS billed,
             try_cast(raw_due_date AS DATE) AS due FROM {{{staging}}})"""


def _list(values: Sequence[str]) -> str:
    return "[" + ", ".join(f"'{v}'" for v in values) + "]"


def _digest_mod(h: str, modulus: int) -> str:
    """A 256-bit digest modulo a small number, from its two 128-bit halves."""
    high = f"CAST('0x' || substr({h}, 1, 32) AS UHUGEINT) % {modulus}"
    low = f"CAST('0x' || substr({h}, 33, 32) AS UHUGEINT) % {modulus}"
    return f"CAST((({high}) * {2**128 % modulus} + ({low})) % {modulus} AS BIGINT)"


def _pick(values: Sequence[str], h: str, divisor: int = 1) -> str:
    return f"({_list(values)})[({_digest_mod(h, divisor * len(values))} // {divisor}) + 1]"


def _pseudonym(name: str, kind: str) -> str:
    h = f"sha256('{SALT}|' || {name})"
    company = f"{_pick(LAST_NAMES, h)} || ' ' || {_pick(COMPANY_TRADES, h, 7)} || ' ' || {_pick(COMPANY_FORMS, h, 11)}"
    if kind == "company":
        return company
    person = f"{_pick(FIRST_NAMES, h)} || ' ' || {_pick(LAST_NAMES, h, 13)}"
    pattern = "\\b(GmbH|AG|KG|e\\.K\\.|UG|Inc|Ltd|SE)\\b"
    return f"CASE WHEN regexp_matches({name}, '{pattern}') THEN {company} ELSE {person} END"


def _address(key: str) -> str:
    h = f"sha256({key})"
    return (
        f"{_pick(STREETS, h, 7)} AS street_name, CAST(1 + {_digest_mod(h, 180)} AS VARCHAR) AS house_number, "
        f"{_pick(POSTAL_CODES, h)} AS postal_code, {_pick(CITIES, h)} AS city"
    )


MOVED = "(SELECT CAST(({as_of} - 3) - max(order_date) AS INT) FROM {{purchase_order}})".format(as_of=AS_OF)

STAGES: dict[str, str] = {
    **{name: _domain(name) for name in _rows()},
    **_chain("", "project", "invoice", "purchase_order", "cost", "schedule_before"),
    # the chain after the import of the second batch
    "checked": _checked("staging"),
    "checked_again": _checked("rerun_staging"),
    "arrived": """
SELECT (SELECT max(invoice_id) FROM {invoice}) + row_number AS invoice_id, CAST(raw_project_id AS BIGINT) AS project_id,
       trim(raw_invoice_number) AS invoice_number, CAST(raw_invoice_date AS DATE) AS invoice_date,
       CAST(raw_due_date AS DATE) AS due_date, CAST(raw_amount AS DECIMAL(12,2)) AS amount, raw_status AS status
FROM {checked_again} WHERE rejection_reason IS NULL""",
    "merged": """
SELECT i.invoice_id, coalesce(a.project_id, i.project_id) AS project_id, i.invoice_number,
       coalesce(a.invoice_date, i.invoice_date) AS invoice_date, coalesce(a.due_date, i.due_date) AS due_date,
       coalesce(a.amount, i.amount) AS amount, coalesce(a.status, i.status) AS status
FROM {invoice} i LEFT JOIN {arrived} a ON a.invoice_number = i.invoice_number
UNION ALL
SELECT invoice_id, project_id, invoice_number, invoice_date, due_date, amount, status
FROM {arrived} WHERE invoice_number NOT IN (SELECT invoice_number FROM {invoice})""",
    **_chain("_imported", "project", "merged", "purchase_order", "cost", "schedule_before"),
    # the same after a run of the chain before it
    "merged_again": """
SELECT i.invoice_id, coalesce(a.project_id, i.project_id) AS project_id, i.invoice_number,
       coalesce(a.invoice_date, i.invoice_date) AS invoice_date, coalesce(a.due_date, i.due_date) AS due_date,
       coalesce(a.amount, i.amount) AS amount, coalesce(a.status, i.status) AS status, milestone_code, schedule_id
FROM {linked} i LEFT JOIN {arrived} a ON a.invoice_number = i.invoice_number
UNION ALL
SELECT invoice_id, project_id, invoice_number, invoice_date, due_date, amount, status, NULL, NULL
FROM {arrived} WHERE invoice_number NOT IN (SELECT invoice_number FROM {invoice})""",
    **_chain("_again", "project", "merged_again", "purchase_order", "cost", "advanced", again=True),
    # the chain after the calendar has moved
    "project_moved": "SELECT * REPLACE (start_date + " + MOVED + " AS start_date) FROM {project}",
    "invoice_moved": "SELECT * REPLACE (invoice_date + " + MOVED + " AS invoice_date) FROM {invoice}",
    "orders_moved": "SELECT * REPLACE (order_date + " + MOVED + " AS order_date) FROM {purchase_order}",
    "cost_moved": "SELECT * REPLACE (cost_date + " + MOVED + " AS cost_date) FROM {cost}",
    **_chain("_moved", "project_moved", "invoice_moved", "orders_moved", "cost_moved", None),
    # ledger
    "posting": f"""
SELECT line, konto, gegenkonto AS geg, soll_haben AS sh, belegfeld1 AS doc, buchungstext AS text, name,
       CASE WHEN umsatz = '' THEN 0 ELSE try_cast(replace(replace(umsatz, '.', ''), ',', '.') AS DECIMAL(12,2)) END AS amount,
       try_cast('{LEDGER_YEAR}-' || right(lpad(belegdatum, 4, '0'), 2) || '-' || left(lpad(belegdatum, 4, '0'), 2) AS DATE) AS date,
       CASE WHEN CAST(gegenkonto AS INT) BETWEEN 10000 AND 69999 THEN 'DEB'
            WHEN CAST(gegenkonto AS INT) BETWEEN 70000 AND 99999 THEN 'KRED' ELSE 'GL' END AS account_class,
       CASE WHEN konto LIKE '4%' AND CAST(gegenkonto AS INT) BETWEEN 10000 AND 69999 THEN 'revenue'
            WHEN konto = '1800' AND CAST(gegenkonto AS INT) BETWEEN 10000 AND 69999 THEN 'customer_payment'
            WHEN left(konto, 1) IN ('5', '6') AND CAST(gegenkonto AS INT) BETWEEN 70000 AND 99999 THEN 'expense'
            WHEN konto = '1800' AND CAST(gegenkonto AS INT) BETWEEN 70000 AND 99999 THEN 'supplier_payment'
            ELSE 'skipped' END AS posting_class
FROM {{ledger}}""",
    "revenue": """
SELECT *, CAST(regexp_extract(doc, '([0-9]+)', 1) AS BIGINT) AS docnum FROM {posting} WHERE posting_class = 'revenue'""",
    "counted": """
SELECT geg, amount, line, doc, sh, docnum,
       coalesce(sum(CASE WHEN sh = 'H' THEN 1 ELSE 0 END) OVER (PARTITION BY geg, amount ORDER BY docnum
         RANGE BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS billed_before,
       row_number() OVER (PARTITION BY geg, amount, sh ORDER BY docnum, line) AS place
FROM {revenue} WHERE amount IS NOT NULL""",
    "demand": """
SELECT *, place + least(0, min(billed_before - place) OVER (PARTITION BY geg, amount ORDER BY place
         ROWS UNBOUNDED PRECEDING)) AS matched_so_far
FROM {counted} WHERE sh = 'S'""",
    "taken": """
SELECT d.line AS credit_line, i.line AS invoice_line, i.doc AS invoice_doc
FROM (SELECT *, lag(matched_so_far, 1, 0) OVER (PARTITION BY geg, amount ORDER BY place) AS matched_before FROM {demand}) d
JOIN {counted} i ON i.sh = 'H' AND i.geg = d.geg AND i.amount = d.amount AND i.place = d.matched_so_far
WHERE d.matched_so_far > d.matched_before""",
    "storno": """
SELECT r.line AS credit_line, r.doc AS credit_doc, r.geg, r.amount, t.invoice_line, t.invoice_doc
FROM {revenue} r LEFT JOIN {taken} t ON t.credit_line = r.line WHERE r.sh = 'S'""",
    "live": """
SELECT * FROM {revenue} WHERE sh = 'H' AND doc NOT IN (SELECT invoice_doc FROM {taken})""",
    "debtor": """
SELECT debtor_account, name FROM (
  SELECT geg AS debtor_account, CASE WHEN name <> '' THEN name ELSE left(text, 40) END AS name,
         row_number() OVER (PARTITION BY geg ORDER BY name = '', posting_class = 'customer_payment', line) AS place
  FROM {posting} WHERE posting_class = 'customer_payment' OR (posting_class = 'revenue' AND name <> '')
) WHERE place = 1""",
    "creditor": """
SELECT creditor_account, name FROM (
  SELECT geg AS creditor_account, left(CASE WHEN name <> '' THEN name ELSE text END, 40) AS name,
         row_number() OVER (PARTITION BY geg ORDER BY line) AS place
  FROM {posting} WHERE posting_class = 'expense'
) WHERE place = 1""",
    # privacy
    "verdict": """
SELECT r.customer_id, CASE WHEN c.customer_id IS NULL THEN 'unknown' WHEN c.pseudonymized_at IS NOT NULL THEN 'already_erased'
         WHEN coalesce(o.n, 0) > 0 THEN 'refused' ELSE 'allowed' END AS verdict,
       CAST(coalesce(o.n, 0) AS BIGINT) AS open_invoices
FROM {erasure_request} r LEFT JOIN {customer_rec} c ON c.customer_id = r.customer_id
LEFT JOIN (SELECT p.customer_id, count(*) AS n FROM {settled_invoice} i JOIN {project} p ON p.project_id = i.project_id
           WHERE i.status IN (SELECT status_code FROM {ref_invoice_status} WHERE counts_as_receivable)
           GROUP BY p.customer_id) o ON o.customer_id = r.customer_id""",
    "to_erase": "SELECT customer_id FROM {verdict} WHERE verdict = 'allowed'",
    "calendar": f"""
SELECT DISTINCT full_date FROM (
  SELECT full_date FROM {{days_before}}
  UNION ALL SELECT CAST(unnest(generate_series({AS_OF} - 30, {LAST}, INTERVAL 1 DAY)) AS DATE))""",
    "watch": f"""
SELECT *, CASE WHEN days_until_due BETWEEN 0 AND 7 THEN 'DUE_SOON' WHEN days_until_due > 7 THEN 'SCHEDULED' ELSE 'OVERDUE' END AS alert_level
FROM (SELECT order_id, supplier_name, credit_limit, payment_terms_days, project_name, order_date, expected_delivery_date,
             order_date + payment_terms_days AS payment_due_date,
             CAST(datediff('day', {AS_OF}, order_date + payment_terms_days) AS INT) AS days_until_due, total_amount, o.status
      FROM {{purchase_order}} o JOIN {{supplier_dim}} USING (supplier_id) JOIN {{project}} USING (project_id)
      WHERE o.status IN ('Ordered', 'Delivered'))""",
    "profit": """
SELECT p.project_id, p.project_name, c.city, p.status, p.total_value, direct_cost, supplier_cost,
       CAST(p.total_value - direct_cost - supplier_cost AS DECIMAL(22,2)) AS gross_margin, invoiced_to_date, received_to_date
FROM {project} p JOIN {customer_rec} c USING (customer_id)
JOIN (
  SELECT project_id, CAST(sum(CASE k WHEN 'direct' THEN v ELSE 0 END) AS DECIMAL(22,2)) AS direct_cost,
         CAST(sum(CASE k WHEN 'ordered' THEN v ELSE 0 END) AS DECIMAL(22,2)) AS supplier_cost,
         CAST(sum(CASE k WHEN 'billed' THEN v ELSE 0 END) AS DECIMAL(22,2)) AS invoiced_to_date,
         CAST(sum(CASE k WHEN 'paid' THEN v ELSE 0 END) AS DECIMAL(22,2)) AS received_to_date
  FROM (
    SELECT project_id, 'direct' AS k, amount AS v FROM {project_cost} JOIN {cost} USING (cost_id)
    UNION ALL SELECT project_id, 'ordered', total_amount FROM {purchase_order}
    UNION ALL SELECT project_id, 'billed', amount FROM {invoice}
    UNION ALL SELECT i.project_id, 'paid', y.amount FROM {payment} y JOIN {invoice} i USING (invoice_id)
    UNION ALL SELECT project_id, 'none', 0 FROM {project}
  ) GROUP BY project_id
) m USING (project_id)""",
}


STORED = ("line_doc", "due", "schedule", "coded", "linked", "advanced")


def statement(final: str) -> str:
    """A final SELECT with every block it needs in front of it."""
    ordered: dict[str, str] = {}

    def need(sql: str) -> None:
        for name in placeholders(sql):
            if name in BASE_TABLES or name in ordered:
                continue
            text = STAGES.get(name) or BLOCKS[name]
            need(text)
            ordered[name] = text

    need(final)
    filled = {n: t.format(**{p: p for p in placeholders(t)}) for n, t in ordered.items()}
    body = final.format(**{p: p for p in placeholders(final)})
    if not filled:
        return body
    # Stages that several others read are worked out once.
    kept = {n: " MATERIALIZED" if n.startswith(STORED) else "" for n in filled}
    return "WITH " + ",\n".join(f"{n} AS{kept[n]} ({t.strip()})" for n, t in filled.items()) + "\n" + body.strip()


def _day_rows(source: str) -> str:
    return f"""
SELECT CAST(strftime(full_date, '%Y%m%d') AS INT) AS date_key, full_date, dayname(full_date) AS day_of_week,
       CAST(day(full_date) AS INT) AS day_of_month, monthname(full_date) AS month_name,
       CAST(month(full_date) AS INT) AS month_num, CAST(quarter(full_date) AS INT) AS quarter,
       CAST(year(full_date) AS INT) AS year, isodow(full_date) >= 6 AS is_weekend
FROM {source}"""


def _text_list(columns: str) -> str:
    return ", ".join(columns.split())


CUSTOMER = (
    "c.customer_id, c.first_name, c.last_name, c.company_name, c.email, c.phone, c.street_name, c.house_number, "
    "c.postal_code, c.city, c.country"
)

RAW = "raw_invoice_number raw_project_id raw_invoice_date raw_due_date raw_amount raw_status"

RUN = f"""
SELECT CAST(1 AS BIGINT) AS run_id, 'SEVDESK' AS source_system, 'batch.csv' AS source_filename, '{RUN_TS}' AS started_at,
       '{RUN_TS}' AS finished_at,
       CASE WHEN count(rejection_reason) = 0 THEN 'Succeeded' WHEN count(rejection_reason) = count(*) THEN 'Failed' ELSE 'Partial' END AS status,
       CAST(count(*) AS INT) AS rows_received, CAST(count(*) - count(rejection_reason) AS INT) AS rows_promoted,
       CAST(count(rejection_reason) AS INT) AS rows_rejected, CAST(NULL AS VARCHAR) AS error_message, 'tester' AS triggered_by
FROM {{checked}}"""

ENTRY = """'{{"row":' || row_number || ',"invoiceNumber":"' || raw_invoice_number || '","reason":"' || rejection_reason || '"}}'"""


def _report(checked: str, kpi: str) -> str:
    return f"""
SELECT CAST(0 AS BIGINT) AS seq, '{{{{"runId":1,"sourceFile":"batch.csv","status":"' ||
       CASE WHEN count(rejection_reason) = 0 THEN 'Succeeded' WHEN count(rejection_reason) = count(*) THEN 'Failed' ELSE 'Partial' END ||
       '","rowsReceived":' || count(*) || ',"upsertedCount":' || (count(*) - count(rejection_reason)) ||
       ',"rejectedCount":' || count(rejection_reason) || ',"rejections":[' AS text FROM {{{checked}}}
UNION ALL
SELECT CAST(row_number AS BIGINT), CASE WHEN row_number = min(row_number) OVER () THEN '' ELSE ',' END || {ENTRY}
FROM {{{checked}}} WHERE rejection_reason IS NOT NULL
UNION ALL
SELECT CAST({2**62} AS BIGINT), '],"kpi":{{{{"outstanding_receivables":' || outstanding_receivables || ',"supplier_due_7_days":' ||
       supplier_due_7_days || ',"projected_30day_net":' || projected_30day_net || ',"active_projects":' || active_projects ||
       ',"days_negative_next_30":' || days_negative_next_30 || '}}}}}}}}' FROM {{{kpi}}}"""


def _totals() -> str:
    parts = []
    for table, cte, kind, amount in (
        ("payment_schedule", "advanced", "status", "expected_amount"),
        ("invoice", "linked", "milestone_code", "amount"),
        ("cashflow_forecast", "forecast", "flow_source", "net_cashflow"),
        ("fact_daily_cashflow", "fact", "date_key", "net_cashflow"),
    ):
        parts.append(
            f"SELECT '{table}' AS table_name, coalesce(CAST({kind} AS VARCHAR), '-') AS kind, count(*) AS row_count, "
            f"CAST(sum({amount}) AS DECIMAL(22,2)) AS amount FROM {{{cte}}} GROUP BY 2"
        )
    return " UNION ALL ".join(parts)


def _digests(tables: dict[str, tuple[str, str]], empty: str = "~") -> str:
    """Rows and a digest of all values for each table: a SELECT and the names of its columns."""
    parts = []
    for name, (sql, columns) in tables.items():
        text = ", ".join(f"coalesce(CAST({c} AS VARCHAR), '{empty}')" for c in sorted(columns.split()))
        value = f"CAST('0x' || substr(md5(concat_ws('|', {text})), 1, 15) AS BIGINT)"
        parts.append(
            f"SELECT '{name}' AS table_name, count(*) AS row_count, CAST(coalesce(sum({value}), 0) AS VARCHAR) AS digest FROM ({sql})"
        )
    return " UNION ALL ".join(parts)


# --- audits, spelled out from the declared tables ------------------------------

AUDITED = {
    **{name: name for name in _rows()},
    "project": "project",
    "customer": "customer_rec",
    "invoice": "invoice",
    "payment": "payment",
    "supplier": "supplier_dim",
    "purchase_order": "purchase_order",
    "cost": "cost",
    "project_cost": "project_cost",
    "operational_cost": "operational_cost",
    "product": "product",
    "project_product": "project_product",
}

# The columns the derived tables have, where they have fewer than declared.
PRESENT = {
    "project": "project_id customer_id project_name status total_value start_date expected_completion_date",
    "customer": "customer_id first_name last_name company_name email phone street_name house_number postal_code city "
    "country pseudonymized_at",
    "invoice": "invoice_id project_id invoice_number invoice_date due_date amount status",
    "payment": "payment_id invoice_id payment_date amount payment_method",
    "supplier": "supplier_id supplier_name credit_limit payment_terms_days",
    "purchase_order": "order_id supplier_id project_id order_date expected_delivery_date total_amount status",
    "cost": "cost_id amount cost_date cost_category",
    "project_cost": "cost_id project_id direct_cost_type cost_category",
    "operational_cost": "cost_id overhead_category cost_category",
    "product": "product_id product_name category unit_cost",
    "project_product": "project_id product_id quantity unit_price_charged",
}


def _present(name: str) -> list[str]:
    return PRESENT[name].split() if name in PRESENT else TABLES[name].column_names


def _key_text(columns: Sequence[str]) -> str:
    return " || '|' || ".join(f"CAST({c} AS VARCHAR)" for c in columns)


def _audit_keys() -> str:
    rules = [("posting", "posting_key", ("l_orderkey", "l_linenumber"))]
    for name, cte in AUDITED.items():
        rules += [(name, cte, key) for key in TABLES[name].keys if set(key) <= set(_present(name))]
    return " UNION ALL ".join(
        f"SELECT '{n}' AS table_name, '{', '.join(k)}' AS key_columns, {_key_text(k)} AS key_value, count(*) AS occurrences "
        f"FROM {{{cte}}} GROUP BY {', '.join(k)} HAVING count(*) > 1"
        for n, cte, k in rules
    )


def _audit_references() -> str:
    parts = []
    for name, cte in AUDITED.items():
        for r in TABLES[name].references:
            if r.parent not in AUDITED or not set(r.columns) <= set(_present(name)):
                continue
            match = " AND ".join(f"p.{pc} = c.{cc}" for cc, pc in zip(r.columns, r.parent_columns))
            given = " AND ".join(f"c.{cc} IS NOT NULL" for cc in r.columns)
            parts.append(
                f"SELECT '{name}' AS table_name, '{r.parent}' AS parent, {_key_text(r.columns)} AS key_value, "
                f"count(*) AS orphan_rows FROM {{{cte}}} c WHERE {given} AND NOT EXISTS "
                f"(SELECT 1 FROM {{{AUDITED[r.parent]}}} p WHERE {match}) GROUP BY {', '.join(r.columns)}"
            )
    return " UNION ALL ".join(parts)


def _audit_checks() -> str:
    parts = []
    for name, cte in AUDITED.items():
        table = TABLES[name]
        for check, predicate in table_predicates(table, _present(name)).items():
            parts.append(
                f"SELECT '{name}' AS table_name, {_key_text(table.primary_key)} AS key_value, '{check}' AS broken_check "
                f"FROM {{{cte}}} WHERE NOT ({predicate})"
            )
    return " UNION ALL ".join(parts)


def _audit_dependencies() -> str:
    rules = [("posting", "posting_key", ("l_orderkey", "l_linenumber"), ["l_partkey", "l_suppkey"])]
    for name, cte in AUDITED.items():
        for key, rest in TABLES[name].functional_dependencies:
            present = [c for c in rest if c in _present(name)]
            if set(key) <= set(_present(name)) and present:
                rules.append((name, cte, key, present))
    return " UNION ALL ".join(
        f"SELECT '{n}' AS table_name, '{', '.join(k)}' AS determinant, {_key_text(k)} AS key_value, count(*) AS combinations "
        f"FROM (SELECT DISTINCT {', '.join([*k, *rest])} FROM {{{cte}}}) GROUP BY {', '.join(k)} HAVING count(*) > 1"
        for n, cte, k, rest in rules
    )


ISA = """
SELECT cost_id, cost_category, cost_id IN (SELECT cost_id FROM {project_cost}) AS has_project_subtype,
       cost_id IN (SELECT cost_id FROM {operational_cost}) AS has_overhead_subtype
FROM {cost} WHERE (cost_id IN (SELECT cost_id FROM {project_cost})) = (cost_id IN (SELECT cost_id FROM {operational_cost}))"""

DIM_COST = f"""
SELECT {_hex("cost_category || '|' || cost_subcategory", 15)} AS cost_type_key, cost_category, cost_subcategory, is_indirect
FROM (
  SELECT cost_category, cost_subcategory, is_indirect FROM {{cost_types_before}}
  UNION ALL SELECT 'Direct Project', type_code, false FROM {{ref_direct_cost_type}}
  UNION ALL SELECT 'Operational Overhead', category_code, true FROM {{ref_overhead_category}}
  WHERE category_code NOT IN (SELECT cost_subcategory FROM {{cost_types_before}}))"""

DIM_PROJECT = """
SELECT b.project_key, b.project_id, coalesce(p.project_name, b.project_name) AS project_name,
       coalesce(p.status, b.status) AS status, coalesce(p.total_value, b.total_value) AS total_value
FROM {dim_project_before} b LEFT JOIN {project} p ON p.project_id = b.project_id
UNION ALL
SELECT project_id, project_id, project_name, status, total_value FROM {project}
WHERE project_id NOT IN (SELECT project_id FROM {dim_project_before})"""

DIM_CUSTOMER = """
SELECT customer_id AS customer_key, customer_id, first_name || ' ' || last_name AS customer_name, city, postal_code
FROM {customer_rec}"""

SHOWN_CUSTOMER = f"""
SELECT debtor_account, shown, {" OR ".join(f"contains(shown, '{form}')" for form in COMPANY_FORMS)} AS company
FROM (SELECT debtor_account, {_pseudonym("coalesce(nullif(name, ''), debtor_account)", "person")} AS shown FROM {{debtor}})"""

MEMO = _pseudonym("coalesce(nullif(left(text, 40), ''), geg)", "company")

OVERHEAD_CASE = (
    "CASE konto " + " ".join(f"WHEN '{a}' THEN '{c}'" for a, c in OVERHEAD_ACCOUNTS.items()) + " ELSE 'Software License' END"
)

REPORT_VALUES = {
    "postings": "count(*) FROM {posting}",
    **{
        name: f"count(*) FROM {{posting}} WHERE posting_class = '{kind}'"
        for name, kind in {
            "revenue": "revenue",
            "customer_payments": "customer_payment",
            "expenses": "expense",
            "supplier_payments": "supplier_payment",
            "skipped": "skipped",
        }.items()
    },
    "credit_notes_matched": "count(invoice_line) FROM {storno}",
    "credit_notes_out_of_period": "count(*) - count(invoice_line) FROM {storno}",
    "documents_reversed": "count(DISTINCT invoice_doc) FROM {storno}",
    "live_invoices": "count(*) FROM {live}",
    "gross_revenue": "sum(amount) FROM {revenue} WHERE sh = 'H'",
    "net_revenue": "sum(amount) FROM {live}",
    "customers": "count(*) FROM {debtor}",
    "suppliers": "count(*) FROM {creditor}",
}


def _ledger_report() -> str:
    parts = []
    for name in REPORT_LINES:
        value, _, rest = REPORT_VALUES[name].partition(" FROM ")
        parts.append(f"SELECT '{name}' AS metric, CAST(coalesce({value}, 0) AS DECIMAL(22,2)) AS value FROM {rest}")
    return " UNION ALL ".join(parts)


def _of(kind: str) -> str:
    return f"count(*) FILTER (posting_class = '{kind}')"


def _euros(amount: str) -> str:
    return f"coalesce(printf('%,.2f', CAST({amount} AS DOUBLE)), 'unreadable')"


def _umlauts(text: str) -> str:
    for letter, spelling in {"ä": "ae", "ö": "oe", "ü": "ue", "ß": "ss"}.items():
        text = f"replace({text}, '{letter}', '{spelling}')"
    return text


CUSTOMERS_OUT = f"""
SELECT debtor_account, first_name, last_name, CASE WHEN company THEN shown ELSE '' END AS company_name,
       {_umlauts("lower(first_name || '.' || last_name || '@example.de')")} AS email,
       {_address("debtor_account")}, 'Germany' AS country
FROM (SELECT *, CASE WHEN company THEN 'Kontakt' ELSE split_part(shown, ' ', 1) END AS first_name,
             CASE WHEN company THEN split_part(shown, ' ', 1) ELSE split_part(shown, ' ', -1) END AS last_name
      FROM ({SHOWN_CUSTOMER}))"""

SUPPLIERS_OUT = f"""
SELECT creditor_account, supplier_name, CAST(7 AS INT) AS payment_terms_days,
       'orders@' || coalesce(nullif(left(regexp_replace(lower(supplier_name), '[^a-z]', '', 'g'), 14), ''), 'supplier') || '.de' AS contact_email
FROM (SELECT creditor_account, {_pseudonym("coalesce(nullif(name, ''), creditor_account)", "company")} AS supplier_name FROM {{creditor}})"""

ERASED = {
    "first_name": "'ANONYMIZED'",
    "last_name": "'ANONYMIZED'",
    "company_name": "NULL",
    "email": "'erased_' || customer_id || '@pseudonymized.invalid'",
    "phone": "NULL",
    "street_name": "'REDACTED'",
    "house_number": "'0'",
    "postal_code": "'00000'",
    "city": "'REDACTED'",
}


def _erased(columns: dict[str, str], flag: str) -> str:
    return ", ".join(f"CASE WHEN {flag} THEN {v} ELSE {c} END AS {c}" for c, v in columns.items())


IN_ERASED = "customer_id IN (SELECT customer_id FROM {to_erase})"

PAYMENTS_OUT = """
SELECT doc AS invoice_number, geg AS debtor_account, date AS payment_date, amount, 'Bank Transfer' AS payment_method
FROM {posting} WHERE posting_class = 'customer_payment'"""

FACT_COLUMNS = "date_key project_key customer_key cost_type_key expected_cash_in expected_cash_out net_cashflow"

DIMENSIONS = {
    "dim_date": (
        _day_rows("{calendar}"),
        "date_key full_date day_of_week day_of_month month_name month_num quarter year is_weekend",
    ),
    "dim_project": (DIM_PROJECT, "project_key project_id project_name status total_value"),
    "dim_customer": (DIM_CUSTOMER, "customer_key customer_id customer_name city postal_code"),
    "dim_cost_type": (DIM_COST, "cost_type_key cost_category cost_subcategory is_indirect"),
}


def _imported(s: str) -> str:
    """The ten tables that an import changes, and the lines of its report."""
    changed = {
        **DIMENSIONS,
        "invoice": (
            f"SELECT *, CASE WHEN invoice_number IN (SELECT invoice_number FROM {{invoice}}) THEN 'seed' ELSE 'etl:sevdesk' END "
            f"AS created_by FROM {{linked{s}}}",
            "invoice_id project_id invoice_number invoice_date due_date amount status created_by milestone_code schedule_id",
        ),
        "payment_schedule": (
            f"SELECT * FROM {{advanced{s}}}",
            "schedule_id project_id milestone_code due_offset_days expected_amount status created_by",
        ),
        "cashflow_forecast": (f"SELECT * FROM {{forecast{s}}}", CASH.replace(",", "")),
        "fact_daily_cashflow": (f"SELECT * FROM {{fact{s}}}", FACT_COLUMNS),
        "stg_sevdesk_invoice": (
            f"SELECT *, run_id * 1099511627776 + row_number AS stg_id, rejection_reason IS NULL AS is_valid, "
            f"CASE WHEN rejection_reason IS NULL THEN '{RUN_TS}' END AS promoted_at FROM {{checked_again}}",
            f"stg_id run_id row_number {RAW} is_valid rejection_reason promoted_at",
        ),
        "etl_run": (
            RUN.replace("{checked}", "{checked_again}"),
            "run_id source_system source_filename started_at finished_at status rows_received rows_promoted rows_rejected "
            "error_message triggered_by",
        ),
    }
    report = _report("checked_again", f"kpi{s}")
    return f"{_digests(changed)} UNION ALL SELECT 'report', seq, text FROM ({report})"


CASH = "project_id, forecast_date, expected_cash_in, expected_cash_out, net_cashflow, flow_source, created_by"

INVOICES_OUT = """
SELECT doc AS invoice_number, '' AS project_id, date AS invoice_date, date + 7 AS due_date, amount,
       CASE WHEN doc IN (SELECT doc FROM {posting} WHERE posting_class = 'customer_payment') THEN 'Paid' ELSE 'Issued' END AS status
FROM {live}"""

COSTS_OUT = f"""
SELECT date AS cost_date, amount, konto AS skr04_account,
       CASE WHEN CAST(konto AS INT) BETWEEN 5000 AND 5499 THEN 'Direct Project' ELSE 'Operational Overhead' END AS cost_category,
       CASE WHEN CAST(konto AS INT) BETWEEN 5000 AND 5499 THEN '' ELSE {OVERHEAD_CASE} END AS overhead_category,
       geg AS creditor_account, {MEMO} AS memo
FROM {{posting}} WHERE posting_class = 'expense'"""

SUPPLIER_PAYMENTS_OUT = f"""
SELECT geg AS creditor_account, date AS payment_date, amount, {MEMO} AS memo FROM {{posting}} WHERE posting_class = 'supplier_payment'"""

OUTPUTS = {
    "customers": (CUSTOMERS_OUT, "debtor_account first_name last_name company_name email street_name house_number postal_code city country"),
    "suppliers": (SUPPLIERS_OUT, "creditor_account supplier_name payment_terms_days contact_email"),
    "invoices_for_pipeline": (INVOICES_OUT, "invoice_number project_id invoice_date due_date amount status"),
    "payments": (PAYMENTS_OUT, "invoice_number debtor_account payment_date amount payment_method"),
    "costs": (COSTS_OUT, "cost_date amount skr04_account cost_category overhead_category creditor_account memo"),
    "supplier_payments": (SUPPLIER_PAYMENTS_OUT, "creditor_account payment_date amount memo"),
}

FINAL: dict[str, str] = {
    # sources and sinks
    "source_invoice_csv": f"""
SELECT CAST(row_number() OVER (ORDER BY row_number) + 1 AS BIGINT) AS row_number,
       {", ".join(f"{c} AS {c[4:]}" for c in RAW.split())} FROM {{staging}}""",
    "source_invoice_json": """
SELECT row_number AS payload_id, CAST(2 AS INT) AS row_number, raw_invoice_number AS invoice_number, raw_project_id AS project_id,
       raw_invoice_date AS invoice_date, raw_due_date AS due_date, CAST(row_number AS VARCHAR) AS amount, raw_status AS status
FROM {staging}
UNION ALL
SELECT row_number, CAST(3 AS INT), raw_invoice_number, '', '', '', '', '' FROM {staging}""",
    "source_ledger_csv": """
SELECT CAST(row_number() OVER (ORDER BY line) + 1 AS BIGINT) AS line, konto, gegenkonto, soll_haben, umsatz, belegdatum,
       belegfeld1, buchungstext, CAST(NULL AS VARCHAR) AS vat, name FROM {ledger}""",
    "source_load_tables": _digests({n: (f"SELECT * FROM {{{cte}}}", " ".join(_present(n))) for n, cte in AUDITED.items()}),
    "sink_csv_outputs": _digests(OUTPUTS, empty=""),
    "sink_snapshot": "SELECT project_id, upper(project_name) AS project_name, total_value FROM {project}",
    "sink_append_log": RUN
    + f"""
UNION ALL SELECT 1, 'SEVDESK', 'batch.csv', '{RUN_TS}', NULL, 'Running', CAST(count(*) AS INT), 0, 0, NULL, 'tester' FROM {{checked}}""",
    # changes to tables
    "mutate_upsert": """
SELECT p.project_id, coalesce(b.project_name, p.project_name) AS project_name, p.status,
       CAST(coalesce(b.total_value + 5, p.total_value) AS DECIMAL(12,2)) AS total_value
FROM {project} p LEFT JOIN {dim_project_before} b ON b.project_id = p.project_id
UNION ALL
SELECT project_id, project_name, status, CAST(total_value + 5 AS DECIMAL(12,2)) FROM {dim_project_before}
WHERE project_id NOT IN (SELECT project_id FROM {project})""",
    "mutate_update_where_distinct": """
SELECT customer_id, CASE WHEN customer_id % 3 <> 0 THEN company_name WHEN customer_id % 2 = 0 THEN last_name END AS company_name
FROM {customer_rec}""",
    "mutate_replace_from_date": f"""
SELECT * FROM {{forecast_before}} WHERE forecast_date < {AS_OF}
UNION ALL SELECT * REPLACE ('fresh' AS created_by) FROM {{forecast_before}} WHERE project_id % 4 = 0""",
    "mutate_stamp_updated": f"""
SELECT project_id, status, CASE WHEN status = 'Completed' THEN '{RUN_TS}' END AS updated_at FROM {{project}}""",
    # rules
    "rule_payment_schedule": "SELECT * FROM {schedule}",
    "rule_classify_invoices": "SELECT invoice_id, project_id, invoice_number, amount, milestone_code FROM {coded}",
    "rule_link_schedule": "SELECT invoice_id, milestone_code, schedule_id FROM {linked}",
    "rule_advance_schedule": "SELECT * FROM {advanced}",
    "rule_forecast": f"""
SELECT {CASH}, project_id AS forecast_id FROM {{forecast_before}} WHERE forecast_date < {AS_OF}
UNION ALL
SELECT {CASH}, (SELECT coalesce(max(project_id), 0) FROM {{forecast_before}} WHERE forecast_date < {AS_OF}) + row_number() OVER (ORDER BY project_id NULLS FIRST, forecast_date,
       expected_cash_in, expected_cash_out, net_cashflow, flow_source)
FROM (SELECT * FROM {{flow_in}} UNION ALL SELECT * FROM {{flow_orders}} UNION ALL SELECT * FROM {{flow_overhead}})""",
    "rule_pipeline_totals": _totals(),
    "forecast_milestones": "SELECT * FROM {flow_in}",
    "forecast_suppliers": "SELECT * FROM {flow_orders}",
    "forecast_overhead": "SELECT * FROM {flow_overhead}",
    # star schema
    "star_dim_date": _day_rows("{calendar}"),
    "star_dim_project": DIM_PROJECT,
    "star_dim_customer": DIM_CUSTOMER,
    "star_dim_cost_type": DIM_COST,
    "star_fact": f"""
SELECT *, CASE WHEN date_key < {AS_OF_KEY} THEN project_key ELSE
         (SELECT coalesce(max(project_key), 0) FROM {{fact_before}} WHERE date_key < {AS_OF_KEY}) + row_number() OVER (PARTITION BY date_key < {AS_OF_KEY}
                            ORDER BY date_key, project_key NULLS FIRST, customer_key NULLS FIRST, cost_type_key NULLS FIRST) END AS fact_id
FROM {{fact}}""",
    "star_refresh": _digests({**DIMENSIONS, "fact_daily_cashflow": ("SELECT * FROM {fact}", FACT_COLUMNS)}),
    # views
    "view_cashflow_30day": "SELECT * FROM {daily}",
    "view_cost_isa_violations": ISA,
    "view_customer_data_export": f"""
SELECT {CUSTOMER}, p.project_id, p.project_name, p.status AS project_status, p.total_value, i.invoice_number, i.invoice_date,
       i.amount AS invoice_amount, i.status AS invoice_status, y.payment_date, y.amount AS payment_amount, y.payment_method
FROM {{payment}} y RIGHT JOIN {{invoice}} i USING (invoice_id) RIGHT JOIN {{project}} p ON p.project_id = i.project_id
RIGHT JOIN {{customer_rec}} c ON c.customer_id = p.customer_id""",
    "view_customer_minimised": """
SELECT customer_id, city, left(postal_code, 2) AS postal_area, country, pseudonymized_at IS NOT NULL AS is_pseudonymised
FROM {customer_rec}""",
    "view_dashboard_kpi": "SELECT * FROM {kpi}",
    "view_etl_rejections": f"""
SELECT run_id, 'batch.csv' AS source_filename, '{RUN_TS}' AS started_at, row_number, raw_invoice_number, raw_project_id,
       raw_amount, rejection_reason FROM {{checked}} WHERE rejection_reason IS NOT NULL""",
    "view_liquidity_alert": """
SELECT full_date, cumulative_position, CASE WHEN cumulative_position < 0 THEN 'NEGATIVE' ELSE 'BELOW_BUFFER' END AS liquidity_status
FROM {daily_moved} WHERE cumulative_position < 10000""",
    "view_payment_schedule": """
SELECT n.schedule_id, n.project_id, n.milestone_code, m.milestone_label, m.percentage, n.due_offset_days, n.expected_amount, n.status
FROM {advanced} n JOIN {ref_milestone_type} m ON m.milestone_code = n.milestone_code""",
    # the share is rounded on whole numbers of cents: tenths of a percent, half away from zero
    "view_project_profitability": """
SELECT project_id, project_name, city, status, total_value, direct_cost, supplier_cost, gross_margin,
       CAST(CASE WHEN total_value <> 0 THEN
         CAST(CASE WHEN gross_margin < 0 THEN -1 ELSE 1 END *
           ((abs(CAST(gross_margin * 100 AS HUGEINT)) * 2000 + CAST(total_value * 100 AS HUGEINT)) // (2 * CAST(total_value * 100 AS HUGEINT)))
           AS DECIMAL(22,1)) * 0.1 END AS DECIMAL(22,1)) AS margin_pct,
       invoiced_to_date, received_to_date
FROM {profit}""",
    "view_supplier_watch": "SELECT * FROM {watch}",
    "dash_stats": """
SELECT outstanding_receivables AS "outstandingReceivables", supplier_due_7_days AS "supplierPaymentsDue",
       projected_30day_net AS "netCashPosition30d", active_projects AS "activeProjects",
       days_negative_next_30 AS "daysNegativeNext30" FROM {kpi}""",
    "dash_cashflow_chart": "SELECT * RENAME (full_date AS forecast_date) FROM {daily}",
    "dash_active_projects": """
SELECT p.project_id, p.project_name, p.total_value, p.status, CAST(coalesce(f.invoiced_to_date, 0) AS DECIMAL(22,2)) AS invoiced_to_date,
       CAST(coalesce(f.received_to_date, 0) AS DECIMAL(22,2)) AS received_to_date,
       count(n.schedule_id) FILTER (n.status = 'Paid') || '/' || count(n.schedule_id) AS milestone_progress
FROM {project} p JOIN {ref_project_status} r ON r.status_code = p.status
LEFT JOIN {profit} f ON f.project_id = p.project_id LEFT JOIN {advanced} n ON n.project_id = p.project_id
WHERE NOT r.is_terminal GROUP BY 1, 2, 3, 4, 5, 6""",
    "dash_supplier_watch": "SELECT * EXCLUDE (credit_limit, payment_terms_days, expected_delivery_date) FROM {watch}",
    # import
    "import_stage": f"""
SELECT run_id * 1099511627776 + row_number AS stg_id, run_id, row_number, {_text_list(RAW)}, false AS is_valid, CAST(NULL AS VARCHAR) AS rejection_reason,
       CAST(NULL AS VARCHAR) AS promoted_at FROM {{staging}}""",
    "import_validate": "SELECT run_id, row_number, rejection_reason IS NULL AS is_valid, rejection_reason FROM {checked}",
    "import_promote": """
SELECT m.*, CASE WHEN invoice_number IN (SELECT invoice_number FROM {invoice}) THEN 'seed' ELSE 'etl:sevdesk' END AS created_by
FROM {merged} m""",
    "import_run_status": f"SELECT run_id, rows_received, rows_promoted, rows_rejected, status FROM ({RUN})",
    "import_rejections": f"""
SELECT run_id, row_number AS row, raw_invoice_number AS "invoiceNumber", rejection_reason AS reason, {ENTRY} AS entry
FROM {{checked}} WHERE rejection_reason IS NOT NULL""",
    "import_run_log": RUN,
    "import_report": _report("checked", "kpi"),
    "import_run": _imported("_imported"),
    "import_increment": _imported("_again"),
    # ledger
    "ledger_parse": "SELECT line, amount, amount IS NULL AS quarantined, doc, text, name FROM {posting}",
    "ledger_date": "SELECT l.line, l.belegdatum, p.date FROM {ledger} l JOIN {posting} p ON p.line = l.line",
    "ledger_account_class": "SELECT line, geg AS gegenkonto, account_class FROM {posting}",
    "ledger_classify": "SELECT line, konto, account_class, posting_class FROM {posting}",
    "ledger_storno_match": "SELECT * FROM {storno}",
    "ledger_live_invoices": "SELECT line, doc, geg, amount, date FROM {live}",
    "ledger_invoices_out": INVOICES_OUT,
    "ledger_payments_out": PAYMENTS_OUT,
    "ledger_costs_out": COSTS_OUT,
    "ledger_supplier_payments_out": SUPPLIER_PAYMENTS_OUT,
    "ledger_debtor_names": "SELECT debtor_account, name FROM {debtor}",
    "ledger_creditor_names": "SELECT creditor_account, name FROM {creditor}",
    "ledger_customers_out": CUSTOMERS_OUT,
    "ledger_suppliers_out": SUPPLIERS_OUT,
    "ledger_unmatched_payments": """
SELECT DISTINCT doc FROM {posting} WHERE posting_class = 'customer_payment' AND doc NOT IN (SELECT doc FROM {live})""",
    "ledger_report": _ledger_report(),
    "ledger_report_lines": f"""
SELECT CAST(1 AS INT) AS section, 'classified ' || count(*) || ' postings: ' || {_of("revenue")} || ' revenue, ' || {_of("customer_payment")} ||
       ' customer payments, ' || {_of("expense")} || ' expenses, ' || {_of("supplier_payment")} || ' supplier payments, ' ||
       {_of("skipped")} || ' internal/GL movements' AS text FROM {{posting}}
UNION ALL
SELECT 2, CASE WHEN invoice_line IS NOT NULL
         THEN 'storno: credit note ' || credit_doc || ' reverses ' || invoice_doc || ' EUR ' || {_euros("amount")} || ' on debtor ' || geg
         ELSE 'storno: credit note ' || credit_doc || ' EUR ' || {_euros("amount")} ||
              ' reverses an invoice billed before this period (debtor ' || geg || ') - excluded from this batch' END
FROM {{storno}}
UNION ALL
SELECT 3, (SELECT count(*) FROM {{revenue}}) || ' revenue postings -> ' || (SELECT count(*) FROM {{live}}) || ' live invoices (' ||
       count(DISTINCT invoice_doc) || ' reversed in-period, ' || (count(*) - count(invoice_line)) || ' credit notes against earlier periods)'
FROM {{storno}}
UNION ALL
SELECT DISTINCT 4, 'payment references an invoice not in this period (billed earlier): ' || doc
FROM {{posting}} WHERE posting_class = 'customer_payment' AND doc NOT IN (SELECT doc FROM {{live}})
UNION ALL
SELECT 5, 'gross credited revenue EUR ' || {_euros("(SELECT sum(amount) FROM {revenue} WHERE sh = 'H')")} ||
       ' -> net of storno EUR ' || {_euros("(SELECT sum(amount) FROM {live})")}
UNION ALL
SELECT 6, 'customers ' || (SELECT count(*) FROM {{debtor}}) || ', suppliers ' || (SELECT count(*) FROM {{creditor}}) || ', invoices ' ||
       (SELECT count(*) FROM {{live}}) || ', customer payments ' || {_of("customer_payment")} || ', supplier payments ' ||
       {_of("supplier_payment")} || ', cost postings ' || {_of("expense")} FROM {{posting}}""",
    # privacy and calendar
    "pseudonymise_names": f"""
SELECT customer_id, {_pseudonym("coalesce(company_name, last_name)", "person")} AS person,
       {_pseudonym("CAST(customer_id AS VARCHAR)", "company")} AS company FROM {{customer_rec}}""",
    "pseudonymise_addresses": f"SELECT customer_id, {_address('CAST(customer_id AS VARCHAR)')} FROM {{customer_rec}}",
    "erasure_check": """
SELECT customer_id, verdict, open_invoices, CASE verdict
         WHEN 'unknown' THEN 'Customer ' || customer_id || ' does not exist'
         WHEN 'already_erased' THEN 'Customer ' || customer_id || ' is already pseudonymised; nothing to do'
         WHEN 'refused' THEN 'Erasure refused: customer ' || customer_id || ' still has ' || open_invoices ||
              ' open invoice(s). Art. 17(3) applies.' END AS message
FROM {verdict}""",
    "erasure_apply": f"""
SELECT customer_id, country, {_erased(ERASED, IN_ERASED)},
       CASE WHEN {IN_ERASED} THEN '{RUN_TS}' ELSE strftime(pseudonymized_at, '%Y-%m-%d %H:%M:%S') END AS pseudonymized_at
FROM {{customer_rec}}""",
    "erasure_log": f"""
SELECT customer_id AS erasure_id, 'customer' AS subject_table, customer_id AS subject_id, '{RUN_TS}' AS requested_at, '{RUN_TS}' AS executed_at,
       'tester' AS executed_by,
       'Art. 17 erasure honoured by pseudonymisation; financial records retained under Section 147 AO (7 years).' AS legal_basis_note,
       'first_name, last_name, company_name, email, phone, street_name, house_number, postal_code, city; dim_customer.customer_name, dim_customer.city, dim_customer.postal_code' AS columns_affected
FROM {{to_erase}}""",
    "erase_customers": f"""
SELECT customer_id AS customer_key, customer_id,
       {_erased({"customer_name": "'ANONYMIZED'", "city": "'REDACTED'", "postal_code": "'00000'"}, IN_ERASED)}
FROM (SELECT customer_id, first_name || ' ' || last_name AS customer_name, city, postal_code FROM {{customer_rec}})""",
    "rebase_dates": "SELECT * FROM {daily_moved}",
    "rebase_report": f"""
SELECT {MOVED} AS "shiftDays", 'newest purchase order sits 3 days before today' AS "anchorRule",
       (SELECT count(*) FROM {{project}}) AS project, (SELECT count(*) FROM {{purchase_order}}) AS purchase_order,
       (SELECT count(*) FROM {{cost}}) AS cost, (SELECT count(*) FROM {{invoice}}) AS invoice, (SELECT count(*) FROM {{payment}}) AS payment,
       (SELECT coalesce(string_agg(full_date || ' ' || cumulative_position || ' ' ||
                 CASE WHEN cumulative_position < 0 THEN 'NEGATIVE' ELSE 'BELOW_BUFFER' END, ', ' ORDER BY full_date), '')
        FROM {{daily_moved}} WHERE cumulative_position < 10000) AS alerts, k.*
FROM {{kpi_moved}} k""",
    # audits
    "audit_keys": _audit_keys(),
    "audit_foreign_keys": _audit_references(),
    "audit_checks": _audit_checks(),
    "audit_functional_dependency": _audit_dependencies(),
    "audit_specialisation": ISA,
}

ORACLES: dict[str, str] = {name: statement(sql) for name, sql in FINAL.items()}
