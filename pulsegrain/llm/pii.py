"""Personal data by bootstrapped contextual extraction.

Base patterns find e-mail and IP addresses, card and phone numbers, and long hexadecimal keys.
These seeds induce lexical patterns: the words before and after an identifier, whole phone numbers
and spaced cards included. Patterns and the identifiers they meet form a graph on which Spark scores
both sides in turn: a pattern is as good as the identifiers it meets, an identifier as the best
pattern that meets it, wherever it occurs. Patterns of high confidence then mark identifiers that no
base pattern knows. All of it is DataFrame expressions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import cut_lineage

KINDS = ("email", "ip", "card", "phone")
#: Known by context only: a hexadecimal key is a secret where a pattern of confidence says so.
SECRET = "secret"

# The base patterns; guards (look-behind, possessive repeats) only save retries that cannot match.
EMAIL = r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}"
CARD = r"(?=[0-9][\x20\x2D0-9]{15})[0-9]++(?:[\x20\x2D][0-9]++)*+"
PHONE = r"\+[0-9][\x20().0-9\x2D]+[0-9]"
IP_PARTS = r"^(?:0*(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])(?:\.|$)){4}$"
PATTERNS = dict(zip(KINDS, (EMAIL, IP, CARD, PHONE), strict=True))
KEY = r"^[0-9a-f]{32,}$"

#: What may be an identifier: from the start of a word on, a number with a sign, one in groups, or
#: a word with a digit or an @; CORE leaves the marks around it.
UNIT = r"(?<!\S)(?:[^\s0-9@+]*+\+[0-9](?:[\x20().\x2D]*+[0-9])*+\S*+|[^\s0-9@]*+[0-9]{1,6}+(?:[\x20\x2D][0-9]++)++\S*+|[^\s0-9@]*+[0-9@]\S*+)"
CORE = r"[A-Za-z0-9+](?:.*[A-Za-z0-9])?"

ROUNDS = 3
#: A pattern counts from so many different identifiers on, and extracts from this score on.
SUPPORT, CONFIDENCE = 5, 0.9
#: Rows of a table of patterns up to which a join may broadcast it.
BROADCAST_ROWS = 50_000


def _luhn(digits: Column) -> Column:
    n = F.length(digits)
    total = F.aggregate(
        F.sequence(F.lit(1), n),
        F.lit(0),
        lambda a, i: a + F.when((n - i) % 2 == 0, _digit(digits, i)).otherwise(_digit(digits, i) * 2 - F.when(_digit(digits, i) > 4, 9).otherwise(0)),
    )
    return F.when(n > 0, total % 10 == 0).otherwise(False)


def _digit(digits: Column, i: Column) -> Column:
    return F.ascii(F.substring(digits, i, F.lit(1))) - 48


def _valid(kind: str, match: Column) -> Column:
    if kind == "ip":
        return match.rlike(IP_PARTS)
    digits = F.regexp_replace(match, "[^0-9]", "")
    if kind == "card":
        return F.when(F.length(digits).between(16, 19), _luhn(digits)).otherwise(False)
    if kind == "phone":
        return F.length(digits).between(8, 15)
    return F.lit(True)


def _texts(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """row, doc_id, hits (matches of base patterns) and units, for each row of docs.

    A hit has kind, nth, m and gap, the length of the text between it and the match before; a unit
    has nth, m, gap and the words around it. What follows needs no text; the row number is fixed
    by the checkpoint.
    """
    texts = docs.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    text = F.col("text")
    may = {"email": text.contains("@"), "ip": text.rlike(r"[0-9]\.[0-9]"), "card": text.rlike(r"[0-9][\x20\x2D0-9]{15}"), "phone": text.contains("+"), "unit": text.rlike("[0-9@]")}
    none = F.array().cast("array<string>")
    for kind, pattern in (*PATTERNS.items(), ("unit", UNIT)):
        found = F.when(may[kind], F.regexp_extract_all("text", F.lit(pattern), F.lit(0))).otherwise(none)
        texts = texts.withColumn(f"m_{kind}", found)
        texts = texts.withColumn(f"b_{kind}", F.when(F.size(f"m_{kind}") > 0, F.split("text", pattern, -1)).otherwise(none))

    def hits(kind: str) -> Column:
        return F.transform(f"m_{kind}", lambda m, i: F.struct(F.lit(kind).alias("kind"), i.alias("nth"), m.alias("m"), F.length(F.get(f"b_{kind}", i)).alias("gap")))

    # a unit without a word beside it has the mark of its neighbour there
    def unit(m: Column, i: Column) -> Column:
        before, after = F.get("b_unit", i), F.get("b_unit", i + 1)
        edge = F.when(i == 0, F.lit("<start>")).otherwise(F.lit("<unit>"))
        ends = F.regexp_extract(before, r"(?<!\S)(\S++)\s*+$", 1)
        second = F.regexp_extract(before, r"(?<!\S)(\S++)\s++\S++\s*+$", 1)
        first = F.regexp_extract(after, r"^\s*+(\S++)", 1)
        beyond = F.when(i == F.size("m_unit") - 1, F.lit("<end>")).otherwise(F.lit("<unit>"))
        left = F.when(ends != "", F.lower(ends)).otherwise(edge)
        far = F.when(ends == "", F.lit("")).when(second != "", F.lower(second)).otherwise(edge)
        return F.struct(i.alias("nth"), m.alias("m"), F.length(before).alias("gap"), left.alias("left"), far.alias("far"), F.when(first != "", F.lower(first)).otherwise(beyond).alias("right"))

    return texts.select("row", "doc_id", F.concat(*[hits(k) for k in KINDS]).alias("hits"), F.transform("m_unit", unit).alias("units"))


def _placed(rows: DataFrame, *keys: str) -> DataFrame:
    """Adds s and e, code points of a match in its text (e exclusive), from the gaps before."""
    order = Window.partitionBy("row", *keys).orderBy("nth").rowsBetween(Window.unboundedPreceding, 0)
    return rows.withColumn("e", F.sum(F.col("gap") + F.length("m")).over(order)).withColumn("s", F.col("e") - F.length("m"))


def base_spans(texts: DataFrame) -> DataFrame:
    """(row, kind, s, e) of each valid match of a base pattern."""
    placed = _placed(texts.select("row", F.inline("hits")), "kind")
    valid = F.lit(False)
    for kind in KINDS:
        valid = F.when(F.col("kind") == kind, _valid(kind, F.col("m"))).otherwise(valid)
    return placed.filter(valid).select("row", "kind", "s", "e")


def sightings(texts: DataFrame) -> DataFrame:
    """A row for each unit: row, s, e, core (the identifier), kind of a seed or null, and its patterns.

    A unit that holds a base match has that as its core, however many words it has. A pattern is
    the word before, the two words before, the word after, or the words on both sides; one word
    alone says little, so it goes with the form of the identifier: whether it begins with a sign,
    has an @, is a number, or mixes letters and digits.
    """
    units = _placed(texts.select("row", F.inline("units")))
    core, kind = F.regexp_extract("m", CORE, 0), F.when(F.regexp_extract("m", CORE, 0).rlike(KEY), F.lit(SECRET))
    for k in reversed(KINDS):
        first = F.get(F.filter(F.regexp_extract_all("m", F.lit(PATTERNS[k]), F.lit(0)), lambda x: _valid(k, x)), 0)  # noqa: B023
        core, kind = F.coalesce(first, core), F.when(first.isNotNull(), F.lit(k)).otherwise(kind)
    units = units.withColumns({"core": core, "kind": kind}).filter("core <> ''")
    plain = F.col("core")
    form = F.when(plain.contains("@"), "at").when(plain.startswith("+"), "sign").when(plain.rlike("^[0-9 .()-]+$"), "number").when(plain.rlike("[0-9]"), "mixed").otherwise("word")
    patterns = F.array(
        F.concat(F.lit("L "), "left", F.lit(" "), form), F.concat(F.lit("R "), "right", F.lit(" "), form), F.concat(F.lit("LL "), "far", F.lit(" "), "left"), F.concat(F.lit("LR "), "left", F.lit(" "), "right")
    )
    s = F.col("s") + F.instr("m", plain) - 1
    return units.select("row", s.alias("s"), (s + F.length(plain)).alias("e"), "core", "kind", patterns.alias("patterns"))


def _allowed(kind: Column, pattern: Column) -> Column:
    """A secret stands behind a name and a sign of assignment; other kinds go by any pattern."""
    return (kind != SECRET) | pattern.rlike("^LL .*[=:]$")


def score_patterns(seen: DataFrame, rounds: int = ROUNDS, support: int = SUPPORT) -> DataFrame:
    """(pattern, kind, score) of each pattern that meets enough believed identifiers.

    seen has a row for each sighting: pattern, core (the identifier) and kind (null if no base
    pattern knows it). A pattern's score is the sum of the beliefs of its different identifiers,
    over their number plus one; an identifier's belief is 1 for a seed, else its best pattern's.
    """
    edges = cut_lineage(seen.groupBy("pattern", "core").agg(F.max("kind").alias("kind")))
    known = edges.filter("kind IS NOT NULL").select("core", "kind").distinct()
    beliefs = known.withColumn("belief", F.lit(1.0))
    # patterns with too few identifiers never count, so they are left out of the rounds
    sizes = edges.groupBy("pattern").agg(F.count("*").alias("n")).filter(F.col("n") >= support)
    plain = cut_lineage(edges.select("pattern", "core").join(sizes, "pattern"))
    patterns = None
    for _ in range(rounds):
        met = plain.join(beliefs, "core").filter(_allowed(F.col("kind"), F.col("pattern"))).groupBy("pattern", "kind").agg(F.sum("belief").alias("sum"), F.count("*").alias("believed"), F.max("n").alias("n"))
        patterns = cut_lineage(met.filter(F.col("believed") >= support).select("pattern", "kind", (F.col("sum") / (F.col("n") + 1)).alias("score")))
        reached = plain.join(_small(patterns), "pattern").groupBy("core", "kind").agg(F.max("score").alias("belief"))
        reached = reached.join(known, ["core", "kind"], "left_anti")
        beliefs = known.withColumn("belief", F.lit(1.0)).unionByName(reached)
    return patterns


def _small(df: DataFrame) -> DataFrame:
    """A checkpointed table, to be broadcast if it has few rows."""
    return F.broadcast(df) if df.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS else df


def find_pii(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", confidence: float = CONFIDENCE) -> DataFrame:
    """doc_id, counts of base spans, their digest, all spans and their number, for each row of docs.

    n_email, n_ip, n_card and n_phone count base spans; base_sha256 is the digest of their list
    kind:start:end, by kind and start; spans lists the discovered ones as well (secrets last), and
    n_spans counts them. A discovered span never overlaps a base span. Null texts are empty. Rows
    with null or equal ids each come back; an empty table gives an empty result; other columns are
    ignored.
    """
    texts = cut_lineage(_texts(docs, id_col, text_col))
    base = cut_lineage(base_spans(texts))
    seen = cut_lineage(sightings(texts))
    scored = score_patterns(seen.select("core", "kind", F.explode("patterns").alias("pattern")))
    sure = _small(cut_lineage(scored.filter(F.col("score") >= confidence)))
    new = seen.filter(F.col("kind").isNull() | (F.col("kind") == SECRET)).select("row", "s", "e", F.explode("patterns").alias("pattern")).join(sure, "pattern")
    best = new.groupBy("row", "s", "e").agg(F.max_by("kind", F.struct("score", "kind")).alias("kind"))
    clash = base.select(F.col("row").alias("r"), F.col("s").alias("bs"), F.col("e").alias("be"))
    found = best.join(clash, (F.col("row") == F.col("r")) & (F.col("bs") < F.col("e")) & (F.col("be") > F.col("s")), "left_anti")
    every = base.withColumn("base", F.lit(True)).unionByName(found.select("row", "kind", "s", "e").withColumn("base", F.lit(False)))
    rank = F.array_position(F.array(*map(F.lit, (*KINDS, SECRET))), F.col("kind"))
    spans = every.groupBy("row").agg(F.array_sort(F.collect_list(F.struct(rank.alias("rank"), "s", "e", "kind", "base"))).alias("x"))
    out = texts.select("row", "doc_id").join(spans, "row", "left").withColumn("x", F.coalesce("x", F.array().cast("array<struct<rank:bigint,s:bigint,e:bigint,kind:string,base:boolean>>")))

    def listed(x: Column) -> Column:
        return F.array_join(F.transform(x, lambda a: F.concat_ws(":", a["kind"], a["s"], a["e"])), ",")

    own = F.filter("x", lambda a: a["base"])
    return out.select(
        "doc_id",
        *[F.size(F.filter(own, lambda a: a["kind"] == k)).cast("long").alias(f"n_{k}") for k in KINDS],  # noqa: B023
        F.sha2(listed(own).cast("binary"), 256).alias("base_sha256"),
        listed(F.col("x")).alias("spans"),
        F.size("x").cast("long").alias("n_spans"),
    )
