"""Line dedup by a segment-partition edit join, in DataFrame operations only.

A line goes if an earlier line of the corpus, in the order (doc_id, line number), equals it or is within `tau` edits of
it. Lines shorter than `exact_chars` stay; those shorter than `near_chars` go only as equal ones. Earlier lines count
whether they go themselves or not.

Two lines within tau edits, the shorter of length l: of its tau + 1 even segments one must occur in the longer line,
near its own place. So each line gives, for every length l it may match, the hashes of its substrings at the places
that tau edits allow (the multi-match-aware windows; for its own length, its own segments are among them). Hashes that
only one line has are dropped in one aggregation. In what remains, every line is compared with the earliest of its
bucket. Lines that stay after that are compared with all earlier ones of a bucket of at most `FEW` lines. Those of larger
ones may share no more than a template: they are cut finer, and only lines that share one of a line's rarest segments are
compared (`rare_pairs`). So neither a bucket of one group of lines nor one of lines that differ costs more than a bounded
number of comparisons and probes for each line, unless their rarest segments are common too.

Comparisons run a banded bit-parallel automaton: for each number of edits a word holds which of the 2 tau + 1 diagonals
are reached, and a column of the matrix takes a few shifts and masks of these words.

null and empty texts have no lines that go. Rows with a null doc_id stay as they are. Rows that repeat a doc_id are one
document. Other columns stay.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from perfloom.llm.tables import bounded, brief_shuffles, checkpoints, dropped, stored

TAU, EXACT_CHARS, NEAR_CHARS = 2, 10, 30


def segments(length: str, parts: int, i: int) -> tuple[str, str]:
    """SQL for (start from 1, length) of the i-th of `parts` even segments of a line, i from 1; the longer ones come last."""
    longer = f"{parts} - {length} % {parts}"
    return f"cast({i - 1} * ({length} div {parts}) + greatest(0, {i - 1} - ({longer})) + 1 as int)", f"cast({length} div {parts} + if({i} > {longer}, 1, 0) as int)"


def probes(lines: DataFrame, tau: int) -> DataFrame:
    """h1, key, own: the hashes under which a line (line, length, h1) meets those within tau edits that are as long or shorter, its own segments among them.

    A row for each place comes before its hash, so that the generated code holds one substring instead of all.
    """
    parts = tau + 1
    places = []
    for delta in range(parts):
        for i in range(1, parts + 1):
            low, high = max(-(i - 1), delta - (parts - i)), min(i - 1, delta + (parts - i))
            places += [(delta, i, shift) for shift in range(low, high + 1)]
    delta, i, shift = (f"get(array({', '.join(map(str, xs))}), place)" for xs in zip(*places, strict=True))
    rows = lines.selectExpr("h1", "line", "length", f"explode(sequence(0, {len(places) - 1})) place").selectExpr("h1", "line", f"length - {delta} target", f"{i} i", f"{shift} shift")
    longer = f"({parts} - target % {parts})"
    start = f"cast((i - 1) * (target div {parts}) + greatest(0, i - 1 - {longer}) + 1 + shift as int)"
    size = f"cast(target div {parts} + if(i > {longer}, 1, 0) as int)"
    return rows.selectExpr("h1", f"xxhash64(target, i, substring(line, {start}, {size})) key", "target = char_length(line) and shift = 0 own")


#: Characters of the segments by which lines of one template are told apart: long ones are rarer, short ones are more.
GRAINS = (8, 3)
#: Lines of a bucket of at most so many are all compared, which is fewer comparisons a line than places to probe.
FEW = 64


def _fine(length: str) -> tuple[str, str, str]:
    """SQL for the number of segments of some `grain` characters of a line, and start and length of the i-th."""
    parts = f"greatest(fewest, {length} div grain)"
    longer = f"({parts} - {length} % {parts})"
    return parts, f"cast((i - 1) * ({length} div {parts}) + greatest(0, i - 1 - {longer}) + 1 as int)", f"cast({length} div {parts} + if(i > {longer}, 1, 0) as int)"


#: Characters whose counts, modulo 16, fill two numbers of fifteen fields of four bits each.
_COUNTED = ("etaoinshrdlucmf", "wypvb0123456789")


def _packed(line: str) -> tuple[str, str]:
    """SQL for columns low and high, which hold a line's counts of `_COUNTED`."""
    count = lambda c: f"char_length({line}) - char_length(translate({line}, '{''.join(sorted({c, c.upper()}))}', ''))"
    low, high = (" | ".join(f"shiftleft(cast(({count(c)}) & 15 as bigint), {4 * i})" for i, c in enumerate(x)) for x in _COUNTED)
    return f"{low} low", f"{high} high"


def _packed_agree(a: tuple[str, str], b: tuple[str, str], tau: int) -> str:
    """SQL that is false for most lines more than tau edits apart, never for others: an edit raises one count at most, and lowers one.

    Fields are subtracted without borrowing from each other. Those up to 7 are rises; their bits are counted by weight.
    """
    fields = lambda digit: int(str(digit) * 15, 16)

    def over(x: str, y: str) -> str:
        less = f"((({x} | {fields(8)}) - ({y} & {fields(7)})) ^ (({x} ^ ~{y}) & {fields(8)}))"
        return " + ".join(f"{w} * bit_count({less} & shiftright(~{less}, {shift}) & {fields(w)})" for w, shift in ((1, 3), (2, 2), (4, 1)))

    both = zip(a, b, strict=True)
    up, down = zip(*((over(x, y), over(y, x)) for x, y in both), strict=True)
    return f"{' + '.join(up)} <= {tau} and {' + '.join(down)} <= {tau}"


def rare_pairs(lines: DataFrame, tau: int) -> DataFrame:
    """pos, other: pairs of lines (bucket, pos, line) of a bucket, `other` the smaller, with all that are within tau edits among them.

    A line cut into any number of segments keeps all but tau of them in every line within tau edits, so one of any tau + 1
    segments. Each line is met under the tau + 1 of its segments that the fewest lines of its length have, cut by the grain
    for which these are the fewest, the coarser one of equals; so what lines of a template have in common makes no pairs.
    The others of its bucket probe the places of these segments only, at the shifts that tau edits allow. Near copies of one
    line with an edit or two more have no three segments of their own; of those that meet, the counts of characters, which
    come along, leave the few that may be within tau edits, before a pair is made of them.
    """
    rows = lines.selectExpr("bucket", "pos", "line", "char_length(line) n", f"{tau + 1} fewest", *_packed("line"))
    parts, start, size = _fine("n")
    grains = rows.drop("bucket").dropDuplicates(["pos"]).withColumn("grain", F.explode(F.array(*[F.lit(g) for g in GRAINS])))
    own = grains.withColumn("i", F.explode(F.expr(f"sequence(1, cast({parts} as int))"))).selectExpr("pos", "n", "grain", "i", f"xxhash64(n, grain, i, substring(line, {start}, {size})) key").checkpoint()
    common = own.groupBy("key").agg(F.count("*").alias("many")).where("many > 1")
    rated = own.join(common, "key", "left").groupBy("pos", "n", "grain").agg(F.slice(F.array_sort(F.collect_list(F.struct(F.coalesce("many", F.lit(1)).alias("many"), "i", "key"))), 1, tau + 1).alias("rare"))
    best = F.min(F.struct(F.aggregate("rare", F.lit(0).cast("long"), lambda a, r: a + r["many"]).alias("many"), (-F.col("grain")).alias("finer"), F.col("grain"), F.col("rare")))
    chosen = rated.groupBy("pos").agg(best.alias("b")).select("pos", "b.grain", "b.rare")
    # A line's segments go to its buckets as one row and are told apart there.
    chosen = rows.select("bucket", "pos", "n", "low", "high").join(chosen, "pos").select("bucket", "pos", "n", "low", "high", "grain", F.explode("rare").alias("r")).select("bucket", "pos", "n", "low", "high", "grain", "r.i", "r.key").checkpoint()
    places = chosen.groupBy("bucket", F.col("n").alias("target")).agg(F.collect_set(F.struct("grain", "i")).alias("places"))
    _, start, size = _fine("target")
    probing = rows.withColumn("delta", F.explode(F.sequence(F.lit(0), F.lit(tau)))).withColumn("target", F.col("n") - F.col("delta")).join(places, ["bucket", "target"])
    slack = f"(({tau} - delta) div 2)"
    probing = probing.withColumn("p", F.explode("places")).selectExpr("bucket", "pos", "line", "n", "fewest", "low", "high", "delta", "target", "p.grain", "p.i")
    probing = probing.withColumn("shift", F.explode(F.expr(f"sequence(cast(-{slack} as int), cast(delta + {slack} as int))")))
    met = probing.where(f"{start} + shift >= 1 and {start} + shift + {size} - 1 <= n").selectExpr("bucket", "pos prober", "low others_low", "high others_high", f"xxhash64(target, grain, i, substring(line, {start} + shift, {size})) key").distinct()
    agree = _packed_agree(("low", "high"), ("others_low", "others_high"), tau)
    return chosen.join(met, ["bucket", "key"]).where(f"pos <> prober and {agree}").selectExpr("greatest(pos, prober) pos", "least(pos, prober) other").distinct()


def may_be_within(a: str, b: str, tau: int, parts: int = 8) -> Column:
    """False for most lines that are more than tau edits apart, never for others: an edit damages one of a's segments at most."""
    there = " + ".join(f"cast(contains({b}, substring({a}, {s}, {z})) as int)" for s, z in (segments(f"char_length({a})", parts, i) for i in range(1, parts + 1)))
    return F.expr(f"abs(char_length({a}) - char_length({b})) <= {tau} and {there} >= {parts - tau}")


#: Letters whose counts rule pairs out: an edit changes no letter's count by more than one, up or down.
_LETTERS = "etaoinshrdlucmfwypvbgkjq"


def letter_counts(line: str) -> Column:
    return F.expr("array(" + ", ".join(f"char_length({line}) - char_length(translate({line}, '{c}{c.upper()}', ''))" for c in _LETTERS) + ")")


def counts_agree(a: str, b: str, tau: int) -> Column:
    """False for pairs of letter counts that need more than tau edits."""
    over = lambda x, y: " + ".join(f"greatest(get({x}, {i}) - get({y}, {i}), 0)" for i in range(len(_LETTERS)))
    return F.expr(f"{over(a, b)} <= {tau} and {over(b, a)} <= {tau}")


def trimmed(pairs: DataFrame, a: str, b: str) -> DataFrame:
    """`pairs` with most of what columns a and b have in common at their beginnings and ends cut off, which changes no edit distance.

    Each of three rounds at either end cuts as many eighths of the shorter line as are equal.
    """
    for side, rest in (("left", "substring({c}, cut + 1)"), ("right", "left({c}, char_length({c}) - cut)")):
        for _ in range(3):
            n = f"least(char_length({a}), char_length({b}))"
            tests = " ".join(f"when {side}({a}, size * {k} div 8) = {side}({b}, size * {k} div 8) then size * {k} div 8" for k in range(8, 0, -1))
            others = [c for c in pairs.columns if c not in (a, b)]
            pairs = pairs.selectExpr(*others, a, b, f"{n} size").selectExpr(*others, a, b, f"cast(case {tests} else 0 end as int) cut")
            pairs = pairs.selectExpr(*others, f"{rest.format(c=a)} {a}", f"{rest.format(c=b)} {b}")
    return pairs


def within_edits(a: str, b: str, tau: int) -> Column:
    """True if columns `a` and `b` are at most tau edits apart.

    Bit d of word k: with k edits, the part read of b has become a part of a that is d - tau longer.
    """
    x, y = F.encode(a, "UTF-32"), F.encode(b, "UTF-32")
    width = 2 * tau + 1
    mask = (1 << width) - 1
    word = lambda acc, k: F.shiftright(acc, k * width).bitwiseAND(F.lit(mask))
    start = sum(sum(1 << (tau + d) for d in range(k + 1)) << (k * width) for k in range(tau + 1))

    def step(acc: Column, j: Column) -> Column:
        char = F.substring(y, j * 4 + 1, F.lit(4))
        match = F.lit(0).cast("long")
        for d in range(width):
            at = j + (d - tau)
            match = match.bitwiseOR(F.when((at >= 0) & (F.substring(x, F.greatest(at, F.lit(0)) * 4 + 1, F.lit(4)) == char), F.lit(1 << d).cast("long")).otherwise(F.lit(0).cast("long")))
        return F.struct(match.alias("m"), acc.alias("s"))

    def words(s: Column, m: Column) -> Column:
        before, after, out = None, None, F.lit(0).cast("long")
        for k in range(tau + 1):
            old = word(s, k)
            new = old.bitwiseAND(m)
            if k:
                new = new.bitwiseOR(before).bitwiseOR(F.shiftright(before, 1)).bitwiseOR(F.shiftleft(after, 1)).bitwiseAND(F.lit(mask))
            before, after = old, new
            out = out.bitwiseOR(F.shiftleft(new, k * width))
        return out

    def both(acc: Column, j: Column) -> Column:
        pair = step(acc, j)
        # A one-element transform binds the match word, so that it is evaluated once.
        return F.transform(F.array(pair), lambda p: words(p["s"], p["m"]))[0]

    n, m = F.char_length(F.col(a)), F.char_length(F.col(b))
    end = F.aggregate(F.when(m > 0, F.sequence(F.lit(0), m - 1)).otherwise(F.array().cast("array<int>")), F.lit(start).cast("long"), both)
    accept = F.lit(False)
    for d in range(width):
        bits = sum(1 << (k * width + d) for k in range(tau + 1))
        accept = accept | ((n - m == d - tau) & (end.bitwiseAND(F.lit(bits)) != 0))
    return (F.abs(n - m) <= tau) & accept


def _split(docs: DataFrame, exact_chars: int) -> DataFrame:
    rows = docs.where("doc_id is not null and text is not null").select("doc_id", F.posexplode(F.split("text", "\n")).alias("no", "line"))
    return rows.withColumn("length", F.char_length("line")).where(F.col("length") >= exact_chars)


#: A line's place in the corpus as one number.
_POSITION = "cast(cast(doc_id as decimal(20,0)) * cast(2147483648 as decimal(10,0)) + no as decimal(31,0))"


def near_lines(docs: DataFrame, lines: DataFrame, tau: int, near_chars: int) -> DataFrame:
    """h1, h2 of the lines that have an earlier line within tau edits, and aren't equal to it.

    `lines` has doc_id, no, length, h1, h2; texts come from `docs`.
    """
    checkpoints(docs.sparkSession)
    least = max(near_chars, 2 * (tau + 1))
    keyed = stored(probes(_split(docs, least).withColumn("h1", F.xxhash64("line")), tau))
    # A bucket without a line whose own segment it is can't hold a pair.
    shared = keyed.groupBy("key").agg(F.min("h1").alias("lo"), F.max("h1").alias("hi"), F.bool_or("own").alias("owned")).where("lo <> hi and owned").select("key").checkpoint()
    buckets = keyed.select("h1", "key").join(bounded(shared), "key").distinct().checkpoint()
    dropped(keyed)
    involved = buckets.select("h1").distinct().checkpoint()
    places = lines.where(F.col("length") >= least).join(bounded(involved), "h1", "left_semi").selectExpr("h1", "h2", f"{_POSITION} pos")
    places = places.groupBy("h1", "h2").agg(F.min("pos").alias("pos")).checkpoint()
    wanted = places.selectExpr("cast(floor(pos / 2147483648) as long) doc_id", "h1", "h2", "pos")
    holders = wanted.select("doc_id").distinct().checkpoint()
    texts = _split(docs.select("doc_id", "text").join(bounded(holders), "doc_id", "left_semi"), least).selectExpr("line", f"{_POSITION} pos")
    texts = texts.join(bounded(places), "pos").dropDuplicates(["pos"]).checkpoint()
    members = buckets.join(texts.select("h1", "pos", F.char_length("line").alias("n"), letter_counts("line").alias("counts")), "h1").select("key", "pos", "n", "counts").checkpoint()
    agree = F.expr(f"abs(n - m) <= {tau}") & counts_agree("counts", "others", tau)

    def close(pairs: DataFrame) -> DataFrame:
        """Of pairs (pos, other) of positions, other earlier: the first ones of those within tau edits."""
        of = lambda k, line: texts.selectExpr(f"pos {k}", f"line {line}")
        found = pairs.distinct().join(of("pos", "x"), "pos").join(of("other", "y"), "other")
        # Without the checkpoint the filter would move down and repeat the expressions of all rounds within itself.
        short = trimmed(found.where(may_be_within("x", "y", tau)).select("pos", "x", "y"), "x", "y").checkpoint()
        few = F.expr(f"char_length(translate(x, y, '')) <= {tau} and char_length(translate(y, x, '')) <= {tau}")
        return short.where(may_be_within("x", "y", tau) & few).where(within_edits("x", "y", tau)).select("pos").distinct()

    leaders = members.groupBy("key").agg(F.min(F.struct("pos", "n", "counts")).alias("first"), F.count("*").alias("size"))
    leaders = leaders.select("key", "size", F.col("first.pos").alias("other"), F.col("first.n").alias("m"), F.col("first.counts").alias("others"))
    led = members.join(leaders, "key").where("pos > other").checkpoint()
    gone = close(led.where(agree).select("pos", "other")).checkpoint()
    # The rest: lines that stay so far, against all earlier ones of their buckets but the earliest.
    left = led.where("size > 2").join(gone, "pos", "left_anti").select("key", "pos", "n", "counts", "other", "size").checkpoint()
    if left.take(1):
        few = left.where(F.col("size") <= FEW).join(members.selectExpr("key", "pos earlier", "n m", "counts others"), "key")
        few = few.where("earlier < pos and earlier > other").where(agree).selectExpr("pos", "earlier other")
        many = left.where(F.col("size") > FEW).select("key", "pos")
        others = members.join(many.select("key").distinct(), "key", "left_semi").selectExpr("key bucket", "pos")
        found = rare_pairs(others.join(texts.select("pos", "line"), "pos").checkpoint(), tau).join(many.select("pos").distinct(), "pos", "left_semi")
        rest = few.unionByName(found)
        gone = gone.unionAll(close(rest))
    return texts.join(gone, "pos", "left_semi").select("h1", "h2")


def _gone(placed: DataFrame, marks: DataFrame) -> DataFrame:
    """doc_id, gone: the numbers of the lines that go."""
    rows = placed.join(marks, ["h1", "h2"]).where("near or pos <> first")
    return rows.groupBy("doc_id").agg(F.collect_set("no").alias("gone"))


def dedup_lines(docs: DataFrame, tau: int = TAU, exact_chars: int = EXACT_CHARS, near_chars: int = NEAR_CHARS, names: tuple[str, str] = ("n_lines", "n_removed")) -> DataFrame:
    """`docs` with the lines that go taken out of `text`, and two columns called `names`, in place of such ones: the lines before and those that went."""
    with brief_shuffles(docs.sparkSession):
        # A table of hashes, so that the text is only read again where it is needed.
        lines = stored(_split(docs, exact_chars).selectExpr("doc_id", "no", "length", "xxhash64(line) h1", "xxhash64(7, line) h2"))
        near = near_lines(docs, lines, tau, near_chars).withColumn("near", F.lit(True)).checkpoint()
        placed = lines.selectExpr("doc_id", "no", "h1", "h2", f"{_POSITION} pos")
        # Lines that occur once and are near none are most; they are left out before the join.
        marks = placed.groupBy("h1", "h2").agg(F.min("pos").alias("first"), F.max("pos").alias("last")).join(near, ["h1", "h2"], "left").where("near or first <> last").drop("last").checkpoint()
        gone = _gone(placed, bounded(marks)).checkpoint()
        dropped(lines)
    gone = bounded(gone)
    docs = docs.drop(*names)
    gone = gone.select(F.col("doc_id").alias("__id"), F.col("gone").alias("__gone"))
    out = docs.join(gone, F.col("doc_id") == F.col("__id"), "left")
    parts = F.split("text", "\n")
    kept = F.array_except(F.sequence(F.lit(0), F.size(parts) - 1), F.col("__gone"))
    text = F.when(F.col("__gone").isNull(), F.col("text")).otherwise(F.array_join(F.transform(kept, lambda i: F.get(parts, i)), "\n"))
    n_lines, n_removed = F.coalesce(F.when(F.col("text").isNotNull(), F.size(parts)), F.lit(0)), F.when(F.col("__gone").isNull(), 0).otherwise(F.size("__gone"))
    return out.select(*[F.col(c) if c != "text" else text.alias("text") for c in docs.columns], n_lines.cast("long").alias(names[0]), n_removed.cast("long").alias(names[1]))
