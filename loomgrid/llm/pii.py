r"""Personal data: patterns propose spans, checksums confirm them, nearby words adjust the score (DataFrame functions only).

Base kinds (email, ip, card, phone) follow fixed patterns and checks and are always kept. Further kinds start at a score
of their own, gain or lose by words within 40 code points before and after the span, and are kept from ``THRESHOLD`` on:
``iban`` needs mod-97 = 1, ``secret`` is a key-shaped token, ``ssn`` needs a context word to pass.

Places are running sums of gap and match lengths, summed in runs, and texts are cut in runs of ``RUN`` code points, so work stays close to
the text's length however many spans it has. The patterns use possessive repetition and look-behind, so a match costs time linear in the text and no recursion; they
match what the greedy forms match, since no repeated class contains the character that follows it.

Defined results: null text is empty and has no spans; spans of different kinds may overlap; repeated rows are each
treated; columns other than the text pass through.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import hex_sha256, let, running, table

THRESHOLD = 0.5
NEAR = 40
#: Code points that are walked over to reach a place in a text.
RUN = 1024


def digits(m: Column) -> Column:
    return F.regexp_replace(m, "[^0-9]", "")


def luhn(m: Column) -> Column:
    """Whether the digits of ``m`` pass Luhn; few digits only reach this."""
    d = F.reverse(digits(m))

    def term(i: Column) -> Column:
        x = F.substring(d, i + 1, F.lit(1)).cast("int")
        return F.when(i % 2 == 0, x).when(x > 4, 2 * x - 9).otherwise(2 * x)

    return F.aggregate(F.sequence(F.lit(0), F.length(d) - 1), F.lit(0), lambda a, i: a + term(i)) % 10 == 0


def mod97(m: Column) -> Column:
    """Whether an IBAN's rearranged digits leave 1 after division by 97."""
    c = F.upper(F.regexp_replace(m, "[ -]", ""))
    turned = F.concat(F.substr(c, F.lit(5)), F.substring(c, 1, 4))
    value = lambda x: F.when(x.rlike("[0-9]"), F.ascii(x) - 48).otherwise(F.ascii(x) - 55)
    return F.aggregate(F.filter(F.split(turned, ""), lambda x: x != ""), F.lit(0), lambda a, x: (F.when(value(x) > 9, a * 100).otherwise(a * 10) + value(x)) % 97) == 1


@dataclass(frozen=True)
class Kind:
    """``cheap`` must match in any text that the pattern matches in; ``valid`` is checked on each match."""

    name: str
    pattern: str
    cheap: str
    valid: object = None
    base: bool = False
    score: float = 1.0
    raises: tuple[str, ...] = field(default=())
    lowers: tuple[str, ...] = field(default=())


PART = "0*(?:25[0-5]|2[0-4][0-9]|1[0-9]{2}|[0-9]{1,2})"
LOCAL = "[A-Za-z0-9._%+-]"

KINDS = (
    Kind("email", rf"(?:\G|(?<!{LOCAL})){LOCAL}++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++", "@", base=True),
    Kind("ip", r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}", r"[0-9]\.[0-9]", lambda m: m.rlike(rf"^{PART}(?:\.{PART}){{3}}$"), base=True),
    Kind("card", r"[0-9](?:[\x20-]?[0-9])++", r"[0-9][\x20-]?[0-9]", lambda m: F.when(F.length(digits(m)).between(12, 19), luhn(m)).otherwise(False), base=True),
    Kind("phone", r"\+[0-9][\x20().0-9-]+[0-9]", r"\+[0-9]", lambda m: F.length(digits(m)).between(9, 15), base=True),
    Kind("iban", r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){2,7}(?:\x20?[A-Z0-9]{1,3})?(?![A-Za-z0-9])", "[A-Z]{2}[0-9]{2}", mod97, score=0.8, raises=("iban", "account", "konto", "bank"), lowers=("example", "part no")),
    Kind("secret", r"(?<![A-Za-z0-9])(?:AKIA[0-9A-Z]{16}|sk-[A-Za-z0-9_-]{20,64}|gh[pousr]_[A-Za-z0-9]{36})(?![A-Za-z0-9])", "AKIA|sk-|gh[pousr]_", score=0.7, raises=("key", "token", "secret"), lowers=("placeholder",)),
    Kind("ssn", r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])", "[0-9]-[0-9]{2}-[0-9]", lambda m: ~m.rlike("^(?:000|666|9[0-9]{2})|-00-|-0000$"), score=0.3, raises=("ssn", "social security"), lowers=("order", "invoice")),
)


def _proposals(text: Column, kind: Kind) -> Column:
    """Array of (at, rank, kind, end, match): the valid matches, from the texts between them."""
    found = F.regexp_extract_all(text, F.lit(kind.pattern), F.lit(0))
    none = F.array().cast("array<struct<at:int,rank:int,kind:string,stop:int,match:string>>")
    rank = next((i for i, k in enumerate(KINDS) if k.name == kind.name), len(KINDS))

    def place(m: Column) -> Column:
        steps = F.zip_with(F.split(text, kind.pattern, -1), m, lambda g, x: F.length(g) + F.length(x))  # one gap more than matches: its sum is null
        spans = lambda e: F.zip_with(m, F.slice(e, F.lit(1), F.size(m)), lambda x, z: F.struct((z - F.length(x)).alias("at"), F.lit(rank).alias("rank"), F.lit(kind.name).alias("kind"), z.alias("stop"), x.alias("match")))
        placed = let(running(steps), spans)
        return F.filter(placed, lambda p: kind.valid(p["match"])) if kind.valid else placed

    return F.when(text.rlike(kind.cheap), let(found, lambda m: F.when(F.size(m) > 0, place(m)).otherwise(none))).otherwise(none)


def _runs(text: Column) -> Column:
    """The text in runs of ``RUN`` code points, so that a place is found without a walk from the start."""
    return F.when(F.length(text) <= RUN, F.array(text)).otherwise(F.regexp_extract_all(text, F.lit(f"(?s).{{1,{RUN}}}"), F.lit(0)))


def _part(runs: Column, at: Column, stop: Column) -> Column:
    """Code points at .. stop (exclusive) of a text given by its runs."""
    first, last = F.floor(at / RUN).cast("int"), F.floor((stop - 1) / RUN).cast("int")
    whole = F.array_join(F.slice(runs, first + 1, F.greatest(last - first + 1, F.lit(0))), "")
    return F.when(stop <= at, "").otherwise(F.substr(whole, at - first * RUN + 1, stop - at))


def _scored(text: Column, spans: Column, kind: Kind) -> Column:
    """The spans whose score, after the words near them, reaches the threshold."""
    if kind.base:
        return spans

    def score(runs: Column, p: Column) -> Column:
        near = F.lower(F.concat(_part(runs, F.greatest(p["at"] - NEAR, F.lit(0)), p["at"]), F.lit(" "), _part(runs, p["stop"], F.least(p["stop"] + NEAR, F.length(text)))))
        up = F.when(near.rlike("|".join(kind.raises)), 0.3).otherwise(0.0) if kind.raises else F.lit(0.0)
        down = F.when(near.rlike("|".join(kind.lowers)), 0.3).otherwise(0.0) if kind.lowers else F.lit(0.0)
        return F.lit(kind.score) + up - down

    return let(spans, lambda s: F.when(F.size(s) == 0, s).otherwise(let(_runs(text), lambda r: F.filter(s, lambda p: score(r, p) >= THRESHOLD))))


def find_spans(df: DataFrame, text: str = "text", kinds: Sequence[Kind] = KINDS) -> DataFrame:
    """``df`` with ``spans``: array of (at, rank, kind, stop, match), sorted, in code points, end exclusive."""
    full = F.coalesce(F.col(text), F.lit(""))
    df = df.drop("spans") if text != "spans" else df
    return df.withColumn("spans", F.sort_array(F.concat(*[_scored(full, _proposals(full, k), k) for k in kinds])))


def redact(df: DataFrame, text: str = "text", kinds: Sequence[Kind] = KINDS) -> DataFrame:
    """``df`` with every span replaced by ``[KIND]``; overlapping spans merge under the first one's kind. Texts without spans stay as they are."""
    columns = df.columns

    def pieces(t: Column, s: Column) -> Column:
        # a span that starts before an earlier one has stopped has no mark of its own
        def out(stops: Column, runs: Column) -> Column:
            mark = lambda p, i: let(F.when(i == 0, 0).otherwise(F.get(stops, i - 1)), lambda z: F.when(p["at"] < z, "").otherwise(F.concat(_part(runs, z, p["at"]), F.lit("["), F.upper(p["kind"]), F.lit("]"))))
            return F.concat(F.array_join(F.transform(s, mark), ""), _part(runs, F.get(stops, F.size(stops) - 1), F.length(t)))

        reached = running(F.transform(s, lambda p: p["stop"]), lambda a, x: F.greatest(a, x))
        return let(F.struct(reached.alias("e"), _runs(t).alias("r")), lambda x: out(x["e"], x["r"]))

    found = find_spans(df.withColumnRenamed("spans", "_spans") if "spans" in columns else df, text, kinds)
    back = found.withColumn(text, F.when(F.size("spans") > 0, pieces(F.col(text), F.col("spans"))).otherwise(F.col(text))).drop("spans")
    return back.select(*[F.col("_spans").alias(c) if c == "spans" else F.col(c) for c in columns])


def listed(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda p: F.concat_ws(":", p["kind"], p["at"].cast("string"), p["stop"].cast("string"))), ",")


def op7_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find_spans(table(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", "spans")
    base = [k.name for k in KINDS if k.base]
    of = lambda k: F.filter("spans", lambda p: p["kind"] == k)
    counts = [F.size(of(k)).cast("long").alias(f"n_{k}") for k in base]
    return found.select("doc_id", *counts, hex_sha256(listed(F.filter("spans", lambda p: p["kind"].isin(*base)))).alias("base_sha256"), listed(F.col("spans")).alias("spans"))


def _oracle() -> str:
    """The same spans in DuckDB, whose regular expressions are linear as they are."""
    plain = {
        "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+",
        "ip": r"[0-9]+(?:\.[0-9]+)(?:\.[0-9]+)(?:\.[0-9]+)",
        "card": r"[0-9](?:[\x20-]?[0-9])+",
        "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
        "secret": r"\b(?:AKIA[0-9A-Z]{16}|sk-[A-Za-z0-9_-]{20,64}|gh[pousr]_[A-Za-z0-9]{36})\b",
    }
    d = "regexp_replace(m, '[^0-9]', '', 'g')"
    digit = f"CAST(substr(reverse({d}), i, 1) AS INT)"
    checks = {
        "ip": f"regexp_matches(m, '^{PART}(?:\\.{PART}){{3}}$')",
        "card": f"length({d}) BETWEEN 12 AND 19 AND list_sum(list_transform(range(1, length({d}) + 1), lambda i: CASE WHEN i % 2 = 1 THEN {digit} WHEN {digit} > 4 THEN 2 * {digit} - 9 ELSE 2 * {digit} END)) % 10 = 0",
        "phone": f"length({d}) BETWEEN 9 AND 15",
    }
    rank = {k.name: i for i, k in enumerate(KINDS)}
    one = " UNION ALL ".join(
        f"SELECT rid, '{k}' AS kind, {rank[k]} AS rank, i, ms[i] AS m, list_sum(list_transform(gs[1:i], lambda g: length(g))) + coalesce(list_sum(list_transform(ms[1:i-1], lambda g: length(g))), 0) AS pos "
        f"FROM (SELECT rid, regexp_extract_all(t, '{p}') AS ms, string_split_regex(t, '{p}') AS gs FROM d WHERE regexp_matches(t, '{p}')) AS x, unnest(range(1, len(ms) + 1)) AS r(i)"
        for k, p in plain.items()
    )
    valid = " ".join(f"WHEN kind = '{k}' THEN {c}" for k, c in checks.items())
    count = ", ".join(f"CAST(count(*) FILTER (WHERE kind = '{k}') AS BIGINT) AS n_{k}" for k in ("email", "ip", "card", "phone"))
    shown = "kind || ':' || CAST(pos AS BIGINT) || ':' || CAST(pos + length(m) AS BIGINT)"
    return f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, row_number() OVER () AS rid FROM documents),
p AS ({one}), v AS (SELECT * FROM p WHERE CASE {valid} ELSE true END)
SELECT any_value(d.doc_id) AS doc_id, {count},
       sha256(coalesce(string_agg({shown}, ',' ORDER BY pos, rank) FILTER (WHERE rank < 4), '')) AS base_sha256,
       coalesce(string_agg({shown}, ',' ORDER BY pos, rank), '') AS spans
FROM d LEFT JOIN v USING (rid) GROUP BY d.rid
"""


QUERIES = {"op7_pii": op7_pii}
#: The oracle leaves out iban and ssn, whose checks and context words only the tests hold against brute force; the tables have none.
ORACLES = {"op7_pii": _oracle()}
