"""Line dedup by a segment-partition edit join, in DataFrame operations only.

Lines within `threshold` edits of each other are one class, and so are their chains; of a class only the first
occurrence (least key, then text, then place) is kept. Lines of fewer than `least` characters are compared exactly.

Each distinct line is cut into threshold + 1 segments. If two lines are within the threshold, one of them has a
segment of the other, of like length, at nearly the same place. A line is indexed under its segments and probes,
for each length up to `threshold` shorter, the substrings that could match (from both ends, by how many edits can
lie on either side); where index and probe have the same key, one row stands for both. Keys that only one line has
are dropped where they are sorted, before any join.

A segment that more than `group_limit` lines have (boilerplate) is not joined. Its lines are cut anew, into more
segments of which more must be equal at once (two of threshold + 2, then four of threshold + 4), with every way the
edits can shift them, so what is common to the whole group alone makes no candidates. What is still crowded after
that is dealt over several tasks.

Candidates are sifted inside the join by lengths and by the parities of the numbers of characters and of neighbouring
characters, of which one edit changes two and four at most; each pair is then verified once by its edit distance, bit-parallel over the band of 2 x threshold + 1
diagonals: for each number of edits a word holds the diagonals reached, and all diagonals advance by one character
with shifts and masks.

Copies of a line are one line, however frequent; what is known of a line reaches its occurrences by a join in which
the most frequent lines (at most HOT_SHARES of them, by their share of all lines) are broadcast.

Defined cases: null and empty texts have no lines; blank lines are kept and never compared; very long texts are split
like any other, and very long lines are compared whole; repeated rows are separate documents, which of two equal ones
counts as first changes no result; a null key sorts first and is a key like any other; ties go to the least key, text
and place; an empty table gives none; other columns are not read, or ride along in `deduplicated`, also if they are
named like a working column (those start with `__line_`, or exist only in tables made here).
"""

from __future__ import annotations

from functools import reduce
from itertools import combinations, product

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gridlore.llm.common import stage
from gridlore.llm.simhash import components

THRESHOLD, LEAST, GROUP_LIMIT = 2, 24, 1024
#: A line that is at least one in so many of all occurrences is broadcast; there are at most so many of them.
HOT_SHARES = 2_000


def _segment(n, parts: int, i):
    """(start, length), from 0, of part i (from 1) of n characters: the last parts are one longer."""
    q, longer = F.floor(n / parts), n % parts
    start = (i - 1) * q + F.greatest(F.lit(0), longer - (parts - i + 1))
    return start.cast("int"), (q + F.when(longer >= parts - i + 1, 1).otherwise(0)).cast("int")


def _shifts(parts: int, chosen, d: int, threshold: int):
    """How far the chosen segments (numbers from 1) can be shifted in a line that is d longer: edits before, between and
    after them are `threshold` at most. For one of threshold + 1 segments, some segment has no more edits on its left than
    segments there, nor on its right; only that one is sought."""
    for s in product(range(-threshold, threshold + 1), repeat=len(chosen)):
        path = (0, *s, d)
        if sum(abs(y - x) for x, y in zip(path, path[1:])) > threshold:
            continue
        if len(chosen) == 1 and parts == threshold + 1 and (abs(s[0]) > chosen[0] - 1 or abs(d - s[0]) > parts - chosen[0]):
            continue
        yield s


def schemes(threshold: int, parts: int, intact: int):
    """What is looked up of a line: (how much shorter the other line is, the chosen segments, their shifts). Those with neither
    also index the line."""
    return [(d, chosen, s) for d in range(threshold + 1) for chosen in combinations(range(1, parts + 1), intact) for s in _shifts(parts, chosen, d, threshold)]


def signatures(lines: DataFrame, threshold: int, least: int, parts: int, intact: int) -> DataFrame:
    """(h, line, n) to (tag, key): keys of lines of which `intact` of `parts` segments are equal at once. All keys probe; those with
    an odd tag index the line too. tag: the even part of h, and that bit."""
    each = [F.struct(F.lit(d).alias("d"), F.lit(int(not d and not any(s))).alias("own"), *(F.lit(c).alias(f"c{k}") for k, c in enumerate(chosen)), *(F.lit(x).alias(f"s{k}") for k, x in enumerate(s))) for d, chosen, s in schemes(threshold, parts, intact)]
    x = lines.select("h", "line", "n", F.explode(F.array(*each)).alias("x")).withColumn("other", F.col("n") - F.col("x.d"))
    places = []
    for k in range(intact):
        start, size = _segment(F.col("other"), parts, F.col(f"x.c{k}"))
        places.append((start + F.col(f"x.s{k}"), size))
    fits = reduce(lambda x, y: x & y, ((a >= 0) & (a + size <= F.col("n")) for a, size in places), F.col("other") >= least)
    key = F.xxhash64("other", *(F.col(f"x.c{k}") for k in range(intact)), *(F.substring(F.col("line"), a + 1, size) for a, size in places))
    return x.filter(fits).select(F.col("h").bitwiseAND(F.lit(-2)).bitwiseOR(F.col("x.own").cast("long")).alias("tag"), key.alias("key"))


def codes(line):
    """The characters of a line as numbers."""
    return F.transform(F.split(line, ""), lambda c: F.ascii(c))


def parities(codes):
    """(odd, odd_pairs): a bit for each of 64 classes of characters, and of neighbouring characters, whether their number is odd. One
    edit changes two at most of the first, and four of the second."""
    fold = lambda numbers: F.aggregate(numbers, F.lit(0).cast("long"), lambda bits, k: bits.bitwiseXOR(F.call_function("shiftleft", F.lit(1).cast("long"), F.pmod(k, F.lit(64)))))
    return fold(codes), fold(F.transform(codes, lambda c, i: c * 37 + F.coalesce(F.get(codes, i + 1), F.lit(0)) * 11))


def within(a, b, threshold: int):
    """Whether two arrays of character codes are within threshold edits: bits stand for diagonals of the band."""
    width = 2 * threshold + 1
    full = (1 << width) - 1

    def step(r, j):
        here = F.get(b, j - 1)
        same = reduce(lambda x, y: x.bitwiseOR(y), (F.when(F.get(a, j + d - threshold - 1) == here, 1 << d).otherwise(0) for d in range(width)))
        out = [r["r0"].bitwiseAND(same)]
        for e in range(1, threshold + 1):
            before = r[f"r{e - 1}"]
            out.append(r[f"r{e}"].bitwiseAND(same).bitwiseOR(before).bitwiseOR(F.shiftright(before, 1)).bitwiseOR(F.shiftleft(out[-1], 1)).bitwiseAND(F.lit(full)))
        return F.struct(*(x.alias(f"r{e}") for e, x in enumerate(out)))

    start = F.struct(*(F.lit(((1 << (e + 1)) - 1) << threshold & full).alias(f"r{e}") for e in range(threshold + 1)))
    steps = F.when(F.size(b) > 0, F.sequence(F.lit(1), F.size(b))).otherwise(F.array().cast("array<int>"))
    last = F.aggregate(steps, start, step)[f"r{threshold}"]
    gap = F.size(a) - F.size(b)
    return (F.abs(gap) <= threshold) & (last.bitwiseAND(F.pow(F.lit(2.0), gap + threshold).cast("int")) != 0)


#: What separates words; a line of nothing else is blank.
SPACE = " \t\n\x0b\x0c\r"


def _blank(line):
    return line.isNull() | (F.ltrim(line, F.lit(SPACE)) == "")


def occurrences(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """A row for each line (for a text without one, a row without): uid of the document's row, key, h (of the text), place from 0,
    id (null: blank)."""
    d = docs.select(F.monotonically_increasing_id().alias("uid"), F.col(key).alias("key"), F.xxhash64(text).alias("h"), F.col(text).alias("text"))
    d = d.select("uid", "key", "h", F.posexplode_outer(F.split("text", "\n")).alias("place", "line"))
    return d.select("uid", "key", "h", "place", F.when(~_blank(F.col("line")), F.unhex(F.md5("line"))).alias("id"))


def _met(lines: DataFrame, threshold: int, least: int, parts: int, intact: int) -> DataFrame:
    """(h, line, n) to (h, own: whether the key indexes the line, key, of: rows of the key), without the keys of one line."""
    by, line = Window.partitionBy("key"), F.shiftright("tag", 1)
    k = signatures(lines, threshold, least, parts, intact)
    k = k.select("tag", "key", F.min(line).over(by).alias("a"), F.max(line).over(by).alias("b"), F.count("*").over(by).alias("of")).filter("a <> b")
    return stage(k.select(F.col("tag").bitwiseAND(F.lit(-2)).alias("h"), (F.col("tag").bitwiseAND(F.lit(1)) == 1).alias("own"), "key", "of"), "line-keys")


def _candidates(met: DataFrame, texts: DataFrame, threshold: int, deal: int | None = None) -> DataFrame:
    """Pairs (a, b) of ids that share a key and pass the sieve. deal: a key is dealt over tasks, so many of its rows to each."""
    slices = F.ceil(F.col("of") / deal).cast("int") if deal else F.lit(1)
    side = met.join(texts.select("h", "id", "n", "odd", "odd_pairs"), "h")
    own = lambda c: [F.col("id").alias(c), *(F.col(x).alias(f"{x}_{c}") for x in ("n", "odd", "odd_pairs"))]
    a = side.filter("own").select("key", F.pmod(F.xxhash64("id"), slices).cast("int").alias("slice"), *own("a"))
    b = side.select("key", (F.explode(F.sequence(F.lit(0), slices - 1)) if deal else F.lit(0)).alias("slice"), *own("b"))
    differ = lambda c: F.bit_count(F.col(f"{c}_a").bitwiseXOR(F.col(f"{c}_b")))
    near = (F.col("a") != F.col("b")) & F.col("n_b").between(F.col("n_a"), F.col("n_a") + threshold) & (differ("odd") <= 2 * threshold) & (differ("odd_pairs") <= 4 * threshold)
    return a.join(b, ["key", "slice"]).filter(near).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))


def edges(docs: DataFrame, text: str = "text", threshold: int = THRESHOLD, least: int = LEAST, small_rows: int = 500_000, group_limit: int = GROUP_LIMIT) -> DataFrame:
    """Pairs (a, b) of ids of different lines within the threshold, of the lines of at least `least` characters. An id is the line's MD5."""
    every = docs.select(F.explode(F.split(F.col(text), "\n")).alias("line")).withColumn("n", F.length("line"))
    every = every.filter((F.col("n") >= least) & ~_blank(F.col("line")))
    h = F.xxhash64("line").bitwiseAND(F.lit(-2))  # lines with the same one are told apart by their ids
    met = _met(every.select("line", "n").distinct().select(h.alias("h"), "line", "n"), threshold, least, threshold + 1, 1)
    wanted = stage(met.select("h").distinct(), "line-candidates")
    chosen = F.broadcast(wanted) if wanted.count() <= small_rows else wanted
    texts = every.withColumn("h", h).join(chosen, "h", "left_semi").select("h", "n", "line").distinct().withColumn("codes", codes(F.col("line")))
    texts = stage(texts.select("h", "n", F.unhex(F.md5("line")).alias("id"), "line", "codes", *(x.alias(c) for c, x in zip(("odd", "odd_pairs"), parities(F.col("codes"))))), "line-texts")
    found, crowd = _candidates(met.filter(F.col("of") <= group_limit), texts, threshold), met
    for parts, intact in ((threshold + 2, 2), (threshold + 4, 4)):
        crowded = stage(crowd.filter(F.col("of") > group_limit).select("h").distinct(), "line-crowded")
        if crowded.isEmpty():
            crowd = None
            break
        crowd = _met(texts.join(crowded, "h", "left_semi"), threshold, least, parts, intact)
        found = found.unionByName(_candidates(crowd.filter(F.col("of") <= group_limit), texts, threshold))
    if crowd is not None:
        found = found.unionByName(_candidates(crowd.filter(F.col("of") > group_limit), texts, threshold, group_limit))
    text_of = lambda c, codes: texts.select(F.col("id").alias(c), F.col("codes").alias(codes))
    pairs = found.distinct().join(text_of("a", "x"), "a").join(text_of("b", "y"), "b")
    return pairs.filter(within(F.col("x"), F.col("y"), threshold)).select("a", "b")


def classes(docs: DataFrame, key: str = "doc_id", text: str = "text", threshold: int = THRESHOLD, least: int = LEAST, **how) -> DataFrame:
    """A row for each line occurrence: uid, key, place, id, class (the least id of its class), kept, exact (a copy of the class's kept line)."""
    links = stage(edges(docs, text, threshold, least, **how), "line-links")
    lines = stage(occurrences(docs, key, text), "lines")
    here = F.struct("key", "h", "uid", "place", "id")
    each = lines.filter(F.col("id").isNotNull()).groupBy("id").agg(F.min(here).alias("first"), F.count("*").alias("of"))
    each = each.join(components(links).select(F.col("node").alias("id"), "root"), "id", "left")
    each = stage(each.filter("of > 1 or root is not null").select("id", "first", "of", F.coalesce("root", "id").alias("class"), F.col("root").isNotNull().alias("linked")), "line-ids")
    # Of a class of several lines the first occurrence of all counts, of any other class the line's own.
    first = stage(each.filter("linked").groupBy("class").agg(F.min("first").alias("of_class")), "line-classes")
    known = stage(each.join(first, "class", "left").select("id", "of", "class", F.coalesce("of_class", "first").alias("first")), "line-firsts")
    every = lines.count()
    hot = known.filter(F.col("of") * HOT_SHARES >= every).select("id", F.col("class").alias("hot_class"), F.col("first").alias("hot_first"))
    j = lines.join(F.broadcast(hot), "id", "left").withColumn("deal", F.when(F.col("hot_class").isNotNull() | F.col("id").isNull(), F.xxhash64("uid", "place")).otherwise(0))
    rest = known.filter(F.col("of") * HOT_SHARES < every).select("id", F.lit(0).cast("long").alias("deal"), "class", "first")
    j = j.join(rest, ["id", "deal"], "left").withColumn("class", F.coalesce("hot_class", "class", "id")).withColumn("first", F.coalesce("hot_first", "first"))
    blank = F.col("id").isNull()
    kept = blank | F.col("first").isNull() | here.eqNullSafe(F.col("first"))
    return j.select("uid", "key", "place", "id", "class", kept.alias("kept"), (~blank & F.coalesce(F.col("first.id") == F.col("id"), F.lit(True))).alias("exact"))


def documents(docs: DataFrame, key: str = "doc_id", text: str = "text", **how) -> DataFrame:
    """Per document: key, n_lines (not blank), n_kept, n_copies (of the class's kept line), n_near, kept_places."""
    c = classes(docs, key, text, **how)
    gone, line = ~F.col("kept"), F.col("id").isNotNull()
    g = c.groupBy("uid", F.col("key").alias(key)).agg(
        F.count_if(line).alias("n_lines"), F.count_if(line & F.col("kept")).alias("n_kept"), F.count_if(gone & F.col("exact")).alias("n_copies"), F.count_if(gone & ~F.col("exact")).alias("n_near"),
        F.array_sort(F.collect_list(F.when(line & F.col("kept"), F.col("place")))).alias("kept_places"),
    )
    return g.drop("uid")


def deduplicated(docs: DataFrame, key: str = "doc_id", text: str = "text", **how) -> DataFrame:
    """docs without the lines that are not kept; their other columns stay."""
    d = stage(docs, "documents")  # the rows' numbers must be the same in both readings
    gone = classes(d, key, text, **how).filter(~F.col("kept")).groupBy("uid").agg(F.collect_set("place").alias("gone"))
    gone = gone.select(F.col("uid").alias("__line_uid"), F.col("gone").alias("__line_gone"))
    left = F.filter(F.split(F.col(text), "\n"), lambda _, i: ~F.array_contains("__line_gone", i))
    j = d.withColumn("__line_uid", F.monotonically_increasing_id()).join(gone, "__line_uid", "left")
    return j.select(*(F.when(F.col("__line_gone").isNull(), F.col(text)).otherwise(F.array_join(left, "\n")).alias(text) if c == text else F.col(c) for c in docs.columns))
