"""Personal data: expressions propose spans, checksums confirm them, context adjusts a score.

Only DataFrame functions run.  A kind has an expression that proposes spans, a rule that
confirms one (range of numbers, Luhn, mod 97, count of digits), a score, and words that
raise the score when they stand near.  A span is kept from ``threshold`` on.  The four base
kinds score above any sensible threshold by themselves; bank accounts need their checksum,
and telephone numbers without a country code need a word that says what they are.

The expressions are written so that they find the same spans as the plain greedy ones in
time linear in the text: a search never starts inside a run that an earlier start covers,
and repeated groups never give back, so a match of any length needs no stack.  Arrays of
matches are worked on in blocks of ``BLOCK``: sums and texts of a block start from those of
the blocks before it, so a very long text full of matches takes time nearly linear in it.

A null or empty text has no spans; repeated rows are judged each; a null id stays null; other
columns are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


#: Characters before and after a span that are searched for context words.
NEAR = 40
THRESHOLD = 0.5
#: Elements of an array that are worked on together.
BLOCK = 512


def _digits(match: Column) -> Column:
    return F.regexp_replace(match, "[^0-9]", "")


def luhn(digits: Column) -> Column:
    """Whether the check digit of a string of digits is right."""
    back = F.reverse(digits)

    def value(i: Column) -> Column:
        d = F.substring(back, i, F.lit(1)).cast("int")
        return F.when(i % 2 == 1, d).otherwise(2 * d - F.when(d > 4, 9).otherwise(0))

    total = F.aggregate(F.sequence(F.lit(1), F.length(back)), F.lit(0), lambda acc, i: acc + value(i))
    return (F.length(digits) > 0) & (total % 10 == 0)


def mod97(account: Column) -> Column:
    """Whether an account number with letters leaves 1 when divided by 97, its head moved last."""
    plain = F.regexp_replace(account, "[^0-9A-Z]", "")
    turned = F.concat(F.substring(plain, F.lit(5), F.length(plain)), F.substring(plain, 1, 4))

    def step(acc: Column, i: Column) -> Column:
        c = F.substring(turned, i, F.lit(1))
        letter = F.ascii(c) - 55
        return F.when(c.between("0", "9"), (acc * 10 + F.ascii(c) - 48) % 97).otherwise((acc * 100 + letter) % 97)

    rest = F.aggregate(F.sequence(F.lit(1), F.length(turned)), F.lit(0), step)
    return F.length(plain).between(15, 34) & (rest == 1)


@dataclass(frozen=True)
class Kind:
    name: str
    pattern: str
    confirmed: Callable[[Column], Column]
    score: float
    raised: float
    words: str
    needs: str | None = None  # without this text in it no span is possible


_OCTET = r"0*(?:25[0-5]|2[0-4][0-9]|1[0-9]{2}|[0-9]{1,2})"

BASE = (
    Kind(
        "email",
        r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
        lambda m: F.lit(True),
        0.9,
        0.1,
        "mail|contact|write",
        "@",
    ),
    Kind(
        "ip",
        r"[0-9](?<![0-9]{2})[0-9]*+(?:\.[0-9]++){3}",
        lambda m: m.rlike(rf"^{_OCTET}(?:\.{_OCTET}){{3}}$"),
        0.6,
        0.3,
        "ip|host|server|address|login",
    ),
    Kind(
        "card",
        r"[0-9](?<![0-9]{2})(?<![0-9][\x20-][0-9])(?:[\x20-]?[0-9]){12,18}(?![\x20-]?[0-9])",
        lambda m: luhn(_digits(m)),
        0.8,
        0.2,
        "card|visa|credit|debit|master|amex|payment",
    ),
    Kind(
        "phone",
        r"\+[0-9][\x20().0-9-]+[0-9]",
        lambda m: F.length(_digits(m)).between(9, 15),
        0.7,
        0.2,
        "phone|tel|call|mobile|fax|ring",
        "+",
    ),
)
MORE = (
    Kind(
        "iban",
        r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:[0-9A-Z]{11,30}|(?:\x20[0-9A-Z]{4}){2,7}(?:\x20[0-9A-Z]{1,3})?)(?![A-Za-z0-9])",
        mod97,
        0.9,
        0.1,
        "iban|account|bank|konto|compte|cuenta",
    ),
    Kind(
        "local_phone",
        r"(?<![0-9A-Za-z+().-])\(?[0-9]{3}\)?[\x20.-][0-9]{3}[\x20.-][0-9]{4}(?![0-9A-Za-z-])",
        lambda m: F.length(_digits(m)) == 10,
        0.3,
        0.4,
        "phone|tel|call|mobile|fax",
    ),
)
KINDS = BASE + MORE
SPAN = "struct<kind:string,start:int,end:int,score:double,order:int>"


def _once(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)``, with the value computed once however often it is used."""
    return F.transform(F.array(value), use)[0]


def _blocks(array: Column) -> Column:
    """An array in consecutive pieces of at most ``BLOCK`` elements."""
    last = F.floor((F.size(array) - 1) / BLOCK).cast("int")
    cut = F.transform(F.sequence(F.lit(0), last), lambda b: F.slice(array, b * BLOCK + 1, BLOCK))
    return F.when(F.size(array) > 0, cut).otherwise(F.slice(F.array(array), 1, 0))


def _running(array: Column, value: Callable[[Column], Column], join: Callable[[Column, Column], Column], what: Callable[[Column, Column], Column], start: int = 0) -> Column:
    """``what(x, r)`` of each element, ``r`` being ``join`` of the values of all before it.

    Blocks are summed up first; then each starts from what those before it give, and only
    grows a list of its own.
    """

    def scan(xs: Column, first: Column, own: Callable[[Column], Column], out: Callable[[Column, Column], Column]) -> Column:
        none = F.slice(F.transform(xs, lambda x: out(x, first)), 1, 0)
        add = lambda acc, x: F.struct(
            join(acc["at"], own(x)).alias("at"), F.concat(acc["out"], F.array(out(x, acc["at"]))).alias("out")
        )
        return F.aggregate(xs, F.struct(first.alias("at"), none.alias("out")), add, lambda acc: acc["out"])

    def whole(block: Column) -> Column:
        return F.aggregate(block, F.lit(start), lambda a, x: join(a, value(x)))

    summed = F.transform(_blocks(array), lambda b: F.struct(b.alias("xs"), whole(b).alias("sum")))
    placed = scan(summed, F.lit(start), lambda b: b["sum"], lambda b, at: F.struct(b["xs"].alias("xs"), at.alias("at")))
    return F.flatten(F.transform(placed, lambda b: scan(b["xs"], b["at"], value, what)))


def _found(text: Column, kind: Kind) -> Column:
    """Start, end and text of every proposed span: the pieces between matches give the places."""
    pieces, matches = F.split(text, kind.pattern, -1), F.regexp_extract_all(text, F.lit(kind.pattern), F.lit(0))
    # The last piece has no match after it.
    pairs = F.filter(F.arrays_zip(pieces.alias("piece"), matches.alias("match")), lambda x: x["match"].isNotNull())

    def place(x: Column, at: Column) -> Column:
        start = at + F.length(x["piece"])
        return F.struct(start.alias("start"), (start + F.length(x["match"])).alias("end"), x["match"].alias("match"))

    size = lambda x: F.length(x["piece"]) + F.length(x["match"])
    found = _once(pairs, lambda xs: _running(xs, size, lambda a, b: a + b, place))
    if kind.needs is None:
        return found
    none = F.expr("cast(array() as array<struct<start:int,end:int,match:string>>)")
    return F.when(F.contains(text, F.lit(kind.needs)), found).otherwise(none)


def _cut(text: Column, first: Column, until: Column) -> Column:
    return F.substring(text, first + 1, until - first)


def _with_text(text: Column, spans: Column, margin: int, what: Callable[[Column, Column, Column], Column]) -> Column:
    """``what(span, stretch, at)`` of each span of an ordered array: the stretch of text
    around its block with a margin, and where that starts.  A text is cut from its start, so
    cutting it once for each block and the stretch for each span keeps both short."""

    def block(xs: Column) -> Column:
        first = F.greatest(xs[0]["start"] - margin, F.lit(0))
        stretch = _cut(text, first, F.element_at(xs, -1)["end"] + margin)
        return _once(F.struct(first.alias("at"), stretch.alias("text")), lambda s: F.transform(xs, lambda x: what(x, s["text"], s["at"])))

    return F.flatten(F.transform(_blocks(spans), block))


def find_personal_data(
    docs: DataFrame,
    kinds: Sequence[Kind] = KINDS,
    threshold: float = THRESHOLD,
    id_col: str = "doc_id",
    text_col: str = "text",
    keep: Sequence[str] = (),
) -> DataFrame:
    """``doc_id``, ``text`` and ``spans`` (kind, start, end, score, order): code points, ends
    excluded, by kind in the order given and then by start.  ``keep`` names more columns to
    carry along.  One pass over the texts, no shuffle."""
    rows = docs.select(
        F.col(f"`{id_col}`").alias("doc_id"),
        F.coalesce(F.col(f"`{text_col}`"), F.lit("")).alias("text"),
        *[F.col(f"`{c}`") for c in keep],
    )
    text = F.col("text")
    rows = rows.withColumns({f"_{i}": _found(text, kind) for i, kind in enumerate(kinds)})

    def scored(i: int, kind: Kind) -> Column:
        def one(x: Column, stretch: Column, at: Column) -> Column:
            before = _cut(stretch, F.greatest(x["start"] - NEAR, F.lit(0)) - at, x["start"] - at)
            after = F.substring(stretch, x["end"] - at + 1, F.lit(NEAR))
            near = F.concat(before, F.lit(" "), after).rlike(rf"(?i)\b(?:{kind.words})")
            score = F.lit(kind.score) + F.when(near, kind.raised).otherwise(0.0)
            return F.struct(
                F.lit(kind.name).alias("kind"), x["start"].alias("start"), x["end"].alias("end"),
                score.alias("score"), F.lit(i).alias("order"),
            )

        good = F.filter(F.col(f"_{i}"), lambda x: kind.confirmed(x["match"]))
        return F.filter(_once(good, lambda xs: _with_text(text, xs, NEAR, one)), lambda s: s["score"] >= threshold)

    spans = F.concat(*[scored(i, kind) for i, kind in enumerate(kinds)])
    return rows.select("doc_id", "text", *[F.col(f"`{c}`") for c in keep], spans.alias("spans"))


def written(spans: Column) -> Column:
    """``kind:start:end`` of each span, comma-joined."""
    return F.array_join(
        F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ","
    )


def redacted(text: Column, spans: Column) -> Column:
    """The text with each span replaced by its kind in brackets; of overlapping spans the
    first, and of those the longest, names the kind."""
    ordered = F.array_sort(
        F.transform(
            spans, lambda s: F.struct(s["start"].alias("start"), (-s["end"]).alias("until"), s["kind"].alias("kind"))
        )
    )

    def covered(s: Column, at: Column) -> Column:
        """A span and the end of all before it; one that starts before that end has no mark."""
        mark = F.when(s["start"] >= at, F.concat(F.lit("["), F.upper(s["kind"]), F.lit("]"))).otherwise("")
        return F.struct(at.alias("start"), F.greatest(s["start"], at).alias("from"), F.greatest(-s["until"], at).alias("end"), mark.alias("mark"))

    ways = _once(ordered, lambda xs: _running(xs, lambda s: -s["until"], F.greatest, covered))
    marked = lambda x, stretch, at: F.concat(_cut(stretch, x["start"] - at, x["from"] - at), x["mark"])
    whole = lambda xs: F.concat(
        F.array_join(_with_text(text, xs, 0, marked), ""), _cut(text, F.element_at(xs, -1)["end"], F.length(text))
    )
    return F.when(F.size(spans) > 0, _once(ways, whole)).otherwise(text)


def personal_data_digest(docs: DataFrame) -> DataFrame:
    """Counts of the base kinds, a digest of their spans, and all spans."""
    found = find_personal_data(docs.select(F.col("doc_id"), F.col("text")))
    base = F.filter("spans", lambda s: s["order"] < len(BASE))

    def of_kind(kind: Kind) -> Column:
        return F.size(F.filter("base", lambda s: s["kind"] == kind.name)).cast("bigint").alias(f"n_{kind.name}")

    return found.select("doc_id", "spans", base.alias("base")).select(
        "doc_id",
        *[of_kind(kind) for kind in BASE],
        F.sha2(F.encode(written(F.col("base")), "UTF-8"), 256).alias("base_sha256"),
        written(F.col("spans")).alias("spans"),
    )


