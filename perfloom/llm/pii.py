"""Personal data and information-theoretic sanitisation, in DataFrame operations only.

E-mail addresses, IP addresses, payment cards and phone numbers are found by their patterns, each kind from left to
right without overlaps; matches that fail their kind's test are dropped.

Each distinct value found is a protected entity. A term (a run of letters) that stands in the same lines as an entity
reveals it. With N distinct lines, of which df(c) hold the entity, df(t) the term and df(t, c) both, the entity's
information is IC(c) = log2(N / df(c)), and the term discloses PMI(t, c) = IC(c) + log2(P(c | t)) of it. Counts may be
small, as most entities stand in one line, so P(c | t) is not df(t, c) / df(t) but the lower end of its Wilson interval:
a term of one line tells much of an entity among many lines and little among few. A term is sanitised in the documents
with that entity if PMI / IC is at least `generalise`; from `remove` on it is taken out, below it becomes `[term]`.
Lines are counted once however often they are copied, so a copied document adds no certainty.

null and empty texts hold nothing. Rows with a null doc_id have their base spans only, and rows that repeat a doc_id
share its entities. Other columns stay, but for those with the names of the result's, which are replaced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from perfloom.llm.tables import bounded, checkpoints, spread_join

KINDS = ("email", "ip", "card", "phone")
# The patterns, written so that each run of characters is read once. A card has 13 to 19 digits, so longer and shorter
# runs of digits need not be matched; an ip is matched whatever its parts are, since a failing one takes its text.
PATTERNS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}",
    "card": r"(?<![0-9])(?<![0-9][\x20-])[0-9](?:[\x20-]?[0-9]){12,18}+(?![\x20-]?[0-9])",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
_PART = "0*(?:[0-9]{1,2}|1[0-9]{2}|2[0-4][0-9]|25[0-5])"
_SPANS = "array<struct<start:int,end:int,value:string>>"
#: Z: standard deviations from P(c | t) to the lower end of its interval, 95 % on one side.
GENERALISE, REMOVE, Z, TERM = 0.8, 0.95, 1.645, r"\p{L}{3,}"


def _valid(kind: str, value: Column) -> Column:
    digits = F.regexp_replace(value, "[^0-9]", "")
    n = F.char_length(digits)
    if kind == "ip":
        return value.rlike(rf"^{_PART}(?:\.{_PART}){{3}}$")
    if kind == "phone":
        return n.between(9, 15)
    if kind == "card":

        def weighed(acc: Column, i: Column) -> Column:
            d = F.substring(digits, i, F.lit(1)).cast("int") * F.when((n - i) % 2 == 1, 2).otherwise(1)
            return acc + F.when(d > 9, d - 9).otherwise(d)

        return n.between(13, 19) & (F.aggregate(F.sequence(F.lit(1), n), F.lit(0), weighed) % 10 == 0)
    return F.lit(True)


def matches(text: Column, pattern: Column, valid) -> Column:
    """The matches of `pattern` for which `valid`: structs of start and end in code points and value."""
    parts = F.arrays_zip(F.split(text, pattern, -1).alias("gap"), F.regexp_extract_all(text, pattern, F.lit(0)).alias("value"))
    empty = F.struct(F.lit(0).alias("at"), F.array().cast(_SPANS).alias("found"))

    def step(acc: Column, m: Column) -> Column:
        start = acc["at"] + F.char_length(m["gap"])
        end = start + F.coalesce(F.char_length(m["value"]), F.lit(0))
        span = F.struct(start.alias("start"), end.alias("end"), m["value"].alias("value"))
        return F.struct(end.alias("at"), F.when(m["value"].isNotNull() & valid(m["value"]), F.array_append(acc["found"], span)).otherwise(acc["found"]).alias("found"))

    return F.aggregate(parts, empty, step, lambda acc: acc["found"])


def base_spans(text: Column, kind: str) -> Column:
    hint = {"email": F.contains(text, F.lit("@")), "phone": F.contains(text, F.lit("+"))}.get(kind, F.lit(True))
    return F.when(hint & text.rlike(PATTERNS[kind]), matches(text, F.lit(PATTERNS[kind]), lambda v: _valid(kind, v))).otherwise(F.array().cast(_SPANS))


def _with_base(docs: DataFrame) -> DataFrame:
    text = F.coalesce("text", F.lit(""))
    return docs.select("*", *[base_spans(text, k).alias(f"__{k}") for k in KINDS])


# Functions of one parameter each: Spark would take a second one for the index.
def _named(kind: str):
    return lambda s: F.concat(F.lit(f"{kind}:"), F.lower(s["value"]))


def _labelled(kind: str):
    return lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), F.lit(f"[{kind}]").alias("label"))


def _written(kind: str):
    return lambda s: F.concat_ws(":", F.lit(kind), s["start"], s["end"])


def least_share(part: Column, whole: Column, z: float) -> Column:
    """The lower end of the Wilson interval of a share of which `part` of `whole` have been seen."""
    p = part / whole
    return (p + z * z / (2 * whole) - z * F.sqrt(p * (1 - p) / whole + z * z / (4 * whole * whole))) / (1 + z * z / whole)


def revealing_terms(docs: DataFrame, generalise: float, z: float) -> DataFrame:
    """doc_id, term, disclosure for the documents whose entities a term reveals."""
    checkpoints(docs.sparkSession)
    rows = docs.where("doc_id is not null and text is not null").select("doc_id", "text")
    any_kind = F.lit(False)
    for k in KINDS:
        any_kind = any_kind | F.col("text").rlike(PATTERNS[k])
    lines = rows.where(any_kind).select("doc_id", F.explode(F.split("text", "\n")).alias("line"))
    found = lines.select("doc_id", "line", F.flatten(F.array(*[F.transform(base_spans(F.col("line"), k), _named(k)) for k in KINDS])).alias("entities"))
    bare = F.col("line")
    for k in KINDS:
        bare = F.regexp_replace(bare, PATTERNS[k], " ")
    # Of each line with entities: its hash, the entities and the terms.
    held = found.where(F.size("entities") > 0).select("doc_id", F.xxhash64("line").alias("line"), F.array_distinct("entities").alias("entities"), F.array_distinct(F.regexp_extract_all(F.lower(bare), F.lit(TERM), F.lit(0))).alias("terms"))
    held = held.checkpoint()
    each = held.select("doc_id", "line", F.explode("entities").alias("entity"), "terms")
    lines_of = each.select("entity", "line").distinct().groupBy("entity").agg(F.count("*").alias("dfc"))
    both = each.select("entity", "line", F.explode("terms").alias("term")).distinct().groupBy("entity", "term").agg(F.count("*").alias("dftc")).checkpoint()
    every = rows.select(F.explode(F.split("text", "\n")).alias("line"))
    words = every.select(F.xxhash64("line").alias("line"), F.explode(F.array_distinct(F.regexp_extract_all(F.lower("line"), F.lit(TERM), F.lit(0)))).alias("term"))
    total = every.select(F.xxhash64("line").alias("line")).distinct().agg(F.count("*").alias("n")).checkpoint()
    # A term reaches the threshold only if it has few lines beside those of the entity, whatever z is. A sketch of each term's lines,
    # with a margin of many times its error, leaves common words out before lines are counted one by one.
    known = both.join(lines_of, "entity").crossJoin(F.broadcast(total)).checkpoint()
    most = known.groupBy("term").agg(F.max(F.col("dftc") * F.pow(F.col("n") / F.col("dfc"), F.lit(1 - generalise))).alias("most")).checkpoint()
    sketched = words.join(bounded(most.select("term")), "term", "left_semi").groupBy("term").agg(F.approx_count_distinct("line", 0.05).alias("about"))
    candidates = bounded(sketched.join(most, "term").where(F.col("about") <= 2 * F.col("most") + 10).select("term").checkpoint())
    dft = words.join(candidates, "term", "left_semi").distinct().groupBy("term").agg(F.count("*").alias("dft"))
    scored = known.join(dft, "term")
    information = F.log2(F.col("n") / F.col("dfc"))
    share = least_share(F.col("dftc"), F.greatest("dft", "dftc"), z)
    scored = scored.withColumn("disclosure", F.when(information > 0, 1 + F.log2(share) / information).otherwise(0.0)).where(F.col("disclosure") >= generalise)
    # An entity may stand in a third of all documents, so its terms come to them as one row.
    holders = each.select("doc_id", "entity").distinct().checkpoint()
    told = scored.groupBy("entity").agg(F.collect_list(F.struct("term", "disclosure")).alias("terms")).join(holders.groupBy("entity").agg(F.count("*").alias("n_docs")), "entity").checkpoint()
    met = spread_join(holders, told, ["entity"], "n_docs", holders.count()).select("doc_id", F.explode("terms").alias("t"))
    return met.groupBy("doc_id", F.col("t.term").alias("term")).agg(F.max("t.disclosure").alias("disclosure"))


def find_personal_data(docs: DataFrame, generalise: float = GENERALISE, remove: float = REMOVE, z: float = Z) -> DataFrame:
    """`docs` with an array of spans for each kind and for terms, and the column `sanitised`: the text with each span replaced by its kind."""
    docs = docs.drop(*KINDS, "term", "sanitised")
    terms = revealing_terms(docs, generalise, z)
    terms = terms.groupBy(F.col("doc_id").alias("__id")).agg(F.sort_array(F.collect_list(F.struct("term", "disclosure"))).alias("__terms")).checkpoint()
    rows = _with_base(docs).join(bounded(terms), F.col("doc_id") == F.col("__id"), "left").drop("__id")
    text = F.coalesce("text", F.lit(""))
    pattern = F.concat(F.lit(r"(?iu)(?<!\p{L})(?:"), F.array_join(F.transform("__terms", lambda t: t["term"]), "|"), F.lit(r")(?!\p{L})"))
    rows = rows.withColumn("__term", F.when(F.col("__terms").isNull(), F.array().cast(_SPANS)).otherwise(matches(text, pattern, lambda v: F.lit(True))))
    gone = lambda s: F.exists("__terms", lambda t: (t["term"] == F.lower(s["value"])) & (t["disclosure"] >= remove))
    labelled = [F.transform(f"__{k}", _labelled(k)) for k in KINDS]
    labelled.append(F.transform("__term", lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), F.when(gone(s), "").otherwise("[term]").alias("label"))))
    spans = F.array_sort(F.flatten(F.array(*labelled)))

    def write(acc: Column, s: Column) -> Column:
        # A span that begins inside an earlier one is covered as far as that goes.
        fresh = s["start"] >= acc["at"]
        out = F.when(fresh, F.concat(acc["out"], F.substring(text, acc["at"] + 1, F.greatest(s["start"] - acc["at"], F.lit(0))), s["label"])).otherwise(acc["out"])
        return F.struct(F.greatest(acc["at"], s["end"]).alias("at"), out.alias("out"))

    begin = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))
    sanitised = F.aggregate(spans, begin, write, lambda a: F.concat(a["out"], F.substring(text, a["at"] + 1, F.char_length(text))))
    rows = rows.withColumn("sanitised", F.when(F.size(spans) > 0, sanitised).otherwise(F.col("text")))
    return rows.drop("__terms").withColumnsRenamed({f"__{k}": k for k in (*KINDS, "term")})


def written(kinds: tuple[str, ...]) -> Column:
    """The spans of `kinds` as kind:start:end, joined by commas."""
    return F.array_join(F.flatten(F.array(*[F.transform(k, _written(k)) for k in kinds])), ",")
