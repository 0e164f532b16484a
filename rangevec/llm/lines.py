"""Fuzzy line dedup, with DataFrame functions alone.

Lines are normalised (lower case, runs of anything but letters and digits to one
space; in scripts without spaces each character is a word). Equal normalised
lines are one distinct line, whatever their length; only the empty line is left
alone. Distinct lines of at least ``min_words`` words have a 64-bit SimHash of
their words of four bytes and more (short ones, common to all lines, would make
lines look alike), cut into ``radius + 2`` blocks: fingerprints that differ in at most
``radius`` bits agree in two blocks at least and meet under that pair of blocks.
Of those that meet, all that differ in at most ``reach`` bits are verified by
edit similarity, in characters or in words; of each connected
group only the first occurrence stays.

A bucket of equal blocks never emits all its pairs. Fingerprints near the
bucket's pivot, its smallest one, are held against the pivot alone, which ties a
group of near-equal lines together by as many links as it has lines; those that
aren't near it are held against all that are near them. Then lines whose
component isn't yet that of the pivot they are near meet the other components
around it. So each pair that meets is either verified or connected already.
Buckets that are found hot in a sample of fingerprints are salted, each salt
with a pivot of its own, and take part whole in that second step.

The SimHash is counted in lanes: a word's hash, shifted and masked, adds one to
each of four counters packed into a long, so sixteen sums count all 64 bits.

A line's identity is the 128-bit digest of its content, and a number that is
written with it. Occurrences of a very common line are combined on the map side;
on the way back AQE splits the side of the occurrences.
"""

from __future__ import annotations

from functools import reduce
from itertools import combinations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rangevec.llm.common import id_and_text, table
from rangevec.llm.components import connected_components
from rangevec.sources.scratch import materialize

MIN_WORDS = 5
LONG_WORD = 4
#: Different words that a pair of lines may have to be compared word by word: as many as there are characters to stand for them.
MOST_DISTINCT = 1_000_000
#: Bits within which two fingerprints are sure to meet, and within which those that meet are verified.
RADIUS, REACH = 3, 10
SIMILARITY = 0.8
#: So many lines may be broadcast by place (some 40 bytes each) to fetch their texts; more are joined.
BROADCAST_LINES = 1_000_000
#: From so many pairs on that are left in the end, one for each two groups goes first.
MANY_LEFT = 50_000
PAIRS_A_TASK = 1000
#: A bucket is hot with so many sampled fingerprints, one in SAMPLE being sampled, and this share of the sample.
SAMPLE, HOT_ROWS, HOT_SHARE, SALTS = 128, 64, 1e-4, 64
#: Thai to Burmese, Khmer, kana and Han: scripts that don't part words by spaces.
_UNSPACED = r"([\u0E00-\u0EFF\u1000-\u109F\u1780-\u17FF\u3040-\u30FF\u3400-\u4DBF\u4E00-\u9FFF\uF900-\uFAFF\x{20000}-\x{3FFFF}])"


def normalise(text: Column) -> Column:
    """A text, of one line or many, in lower case with runs of anything but letters and digits as one space."""
    return F.regexp_replace(F.lower(text), r"[^\p{L}\p{N}\n]+", " ")


def _wide(line: Column, chars: Column) -> Column:
    return F.octet_length(line) >= 2 * chars


def parted(line: Column, chars: Column | None = None) -> Column:
    """A normalised line (of ``chars`` characters) without blanks at its ends; characters of unspaced scripts stand alone where most of a line is of three bytes a character."""
    chars = F.length(line) if chars is None else chars
    apart = F.regexp_replace(F.regexp_replace(line, _UNSPACED, " $1 "), " +", " ")
    return F.trim(F.when(_wide(line, chars), apart).otherwise(line))


#: Words that a counter of 16 bits can count, with room for the comparison.
MOST = 16383
LANES = [f"_lane{j}" for j in range(16)]


def _ones(width: int) -> Column:
    return F.lit(sum(1 << at for at in range(0, 64, width)))


def _total(terms) -> Column:
    return reduce(lambda a, b: a + b, terms)


def _over_half(total: Column, n: Column, width: int) -> Column:
    """One at the lowest bit of each lane of ``width`` bits whose count is over n / 2; counts stay below a quarter of the lane."""
    flag = width - 2
    return F.shiftrightunsigned(total + _ones(width) * (F.lit((1 << flag) - 1) - F.floor(n / 2)), flag).bitwiseAND(_ones(width))


def _fingerprint(lanes: list, n: Column) -> Column:
    width = len(lanes)
    bits = [F.shiftleft(_over_half(x, n, width), j) for j, x in enumerate(lanes)]
    out = bits[0]
    for b in bits[1:]:
        out = out.bitwiseOR(b)
    return out


def with_simhash(rows: DataFrame, hashes: str = "hashes", out: str = "fp") -> DataFrame:
    """``rows`` with the SimHash of an array column of 64-bit hashes (not empty), of any number."""
    lane = lambda j: F.aggregate(hashes, F.lit(0).cast("long"), lambda a, h: a + F.shiftrightunsigned(h, j).bitwiseAND(_ones(32)))
    return rows.withColumn(out, _fingerprint([lane(j) for j in range(32)], F.size(hashes)))


def telling(words: str = "words") -> Column:
    """A line's words of four bytes and more, which tell lines apart, if there are five; else all."""
    long = F.filter(words, lambda w: F.octet_length(w) >= LONG_WORD)
    return F.when(F.size(long) >= MIN_WORDS, long).otherwise(F.col(words))


#: Words of four bytes and more: four characters, three not all ASCII, two beyond it or one of them beyond two bytes, one of four bytes.
_LONG = (
    r"(?<![^ ])(?:[^ ]{4,}|(?=[^ ]{0,2}[^\x00-\x7F])[^ ]{3}|[^\x00-\x7F]{2}|[^ ][\x{800}-\x{10FFFF}]|[\x{800}-\x{10FFFF}][^ ]|[\x{10000}-\x{10FFFF}])(?![^ ])"
)
#: So many words of a line are one row until the map side combines them.
AT_ONCE = 4
#: So many words of a line are looked at one by one before it is searched for five long ones.
FIRST = 12


def _few_long() -> Column:
    """Whether fewer than five words are long: what ``telling`` asks, without a function of arrays, which would cost a copy of all words at each step."""
    found = F.lit(0)
    for i in range(FIRST):
        found = found + F.when(F.octet_length(F.get("words", F.lit(i))) >= LONG_WORD, 1).otherwise(0)
    return F.when(found >= MIN_WORDS, False).otherwise(F.regexp_count("norm", F.lit(_LONG)) < MIN_WORDS)


def _lines(docs: DataFrame, id_col: str, text_col: str, only: str = "true") -> DataFrame:
    """(doc_id, line_no, line) of all lines but empty ones, of which ``only`` may choose some."""
    rows = id_and_text(docs, id_col, text_col).where("doc_id IS NOT NULL")
    lines = rows.select("doc_id", F.posexplode(F.split(normalise(F.col("text")), "\n")).alias("line_no", "line"))
    return lines.where(f"line NOT IN ('', ' ') AND {only}")  # told before the rest, which would else be done twice


def occurrences(docs: DataFrame, id_col: str, text_col: str, only: str = "true") -> DataFrame:
    """(doc_id, line_no, norm, words) of all lines but empty ones, of which ``only`` may choose some by ``line``."""
    lines = _lines(docs, id_col, text_col, only)
    return lines.select("doc_id", "line_no", parted(F.col("line")).alias("norm")).withColumn("words", F.split("norm", " "))


def _counted(docs: DataFrame, min_words: int, id_col: str, text_col: str) -> DataFrame:
    """(doc_id, line_no, h, len, n, fp) of all lines but empty ones; those that may have over MOST words have a len of 0 and nothing else that is right."""
    digest, size = F.unhex(F.md5("norm")).alias("h"), F.size("words").alias("n")
    # each step names what the next uses more than once, and a filter would be moved down and do it all again
    lines = _lines(docs, id_col, text_col).withColumn("line", F.when(F.octet_length("line") < 2 * MOST, F.col("line")).otherwise(""))
    lines = lines.withColumn("chars", F.length("line"))
    lines = lines.withColumn("norm", parted(F.col("line"), F.col("chars"))).withColumn("words", F.split("norm", " "))
    blanks = F.octet_length("line") - F.octet_length("norm")  # trimmed off, where nothing was put in
    letters = F.when(_wide(F.col("line"), F.col("chars")), F.length("norm")).otherwise(F.col("chars") - blanks) - F.size("words") + 1
    lines = lines.select("doc_id", "line_no", digest, letters.alias("len"), size, _few_long().alias("few"), "words", F.monotonically_increasing_id().alias("rid"))
    keys = ["rid", "doc_id", "line_no", "h", "len", "n"]
    at = F.explode(F.sequence(F.lit(0), F.col("n") - 1, F.lit(AT_ONCE))).alias("at")
    some = [F.get("words", F.col("at") + i).alias(f"_w{i}") for i in range(AT_ONCE)]
    counts = lambda w: (F.octet_length(w) >= LONG_WORD) | (F.col("few") & F.col(w).isNotNull())
    each = lines.select(*keys, "few", "words", at).select(*keys, "few", *some)
    each = each.select(*keys, *[F.when(counts(f"_w{i}"), F.xxhash64(f"_w{i}")).otherwise(0).alias(f"_x{i}") for i in range(AT_ONCE)], _total(F.when(counts(f"_w{i}"), 1).otherwise(0) for i in range(AT_ONCE)).alias("m"))
    sums = [F.sum(_total(F.shiftrightunsigned(f"_x{i}", j).bitwiseAND(_ones(16)) for i in range(AT_ONCE))).alias(c) for j, c in enumerate(LANES)]
    counted = each.groupBy(*keys).agg(F.sum("m").alias("m"), *sums).withColumn("fp", _fingerprint([F.col(c) for c in LANES], F.col("m")))
    return counted.select("doc_id", "line_no", "h", "len", "n", F.when(F.col("n") >= min_words, F.col("fp")).alias("fp"))


def fingerprinted(docs: DataFrame, min_words: int, id_col: str, text_col: str) -> DataFrame:
    """(doc_id, line_no, h, len, n, fp) of all lines but empty ones, written; no fingerprint for those of fewer words.

    Lines too short for more than MOST words are counted by an aggregate, a row for some words
    until the map side combines them; longer ones, if there are any, are one row each throughout.
    """
    counted = materialize(_counted(docs, min_words, id_col, text_col), "lines")
    if not counted.where("len = 0").head(1):
        return counted
    # lower case takes half as many bytes more at most
    wide = occurrences(docs.where(F.octet_length(F.col(text_col)) > MOST), id_col, text_col, f"octet_length(line) >= {2 * MOST}")
    wide = wide.select("doc_id", "line_no", F.unhex(F.md5("norm")).alias("h"), (F.length("norm") - F.size("words") + 1).alias("len"), F.size("words").alias("n"), telling().alias("words"))
    wide = with_simhash(wide.withColumn("words", F.transform("words", lambda w: F.xxhash64(w))), "words")
    wide = wide.select(*counted.columns[:-1], F.when(F.col("n") >= min_words, F.col("fp")).alias("fp"))
    return counted.where("len > 0").unionByName(materialize(wide, "long-lines"))


def block_keys(fp: str, radius: int = RADIUS) -> Column:
    """A key for each pair of blocks: which pair, and the bits of both."""
    n = radius + 2
    edges = [64 * i // n for i in range(n + 1)]
    wide = max(z - a for a, z in zip(edges, edges[1:]))
    block = [F.shiftrightunsigned(fp, a).bitwiseAND(F.lit((1 << (z - a)) - 1)) for a, z in zip(edges, edges[1:])]
    pairs = [F.lit(no << 2 * wide).bitwiseOR(F.shiftleft(block[a], wide)).bitwiseOR(block[b]) for no, (a, b) in enumerate(combinations(range(n), 2))]
    return F.array(*pairs)


def with_similar(pairs: DataFrame, a: str, b: str, similarity: float) -> DataFrame:
    """``pairs`` with ``ok`` in place of the normalised lines ``a`` and ``b``: whether they have the edit similarity, in words or, word by word, in characters.

    In words: the edit distance of the sequences of words is at most the share
    1 - ``similarity`` of the longer one, found exactly in a band no wider than
    need be. In characters: lines of equally many words, each edited into the one
    in its place, take at most that share of the longer line, spaces left out;
    this forgives two misspelt words of five. Both are the same at any length.
    """
    slack = lambda n: F.floor(n * (1 - similarity) + 1e-9).cast("int")
    kept = [c for c in pairs.columns if c not in (a, b)]
    letters = lambda c: F.length(c) - F.size(F.split(c, " ")) + 1
    split = pairs.select(*kept, F.split(a, " ").alias("_x"), F.split(b, " ").alias("_y"), slack(F.greatest(letters(a), letters(b))).alias("_letters"))
    # words that the other line hasn't at all have to be edited
    missing = F.greatest(F.size(F.array_except("_x", "_y")), F.size(F.array_except("_y", "_x")))
    hopeless = missing > slack(F.greatest(F.size("_x"), F.size("_y")))
    ok = F.when(_in_order("_x", "_y") <= F.col("_letters"), True).when(hopeless, False).otherwise(_near_in_words("_x", "_y", slack))
    return split.select(*kept, ok.alias("ok"))


def _near_in_words(a: str, b: str, slack) -> Column:
    """Whether the edit distance in words is within the slack: each different word of the pair is one character."""
    bands = [2]
    while bands[-1] < MOST_DISTINCT:
        bands.append(bands[-1] * 5 // 4 + 1)
    pair = F.array(F.struct(F.col(a).alias("a"), F.col(b).alias("b")))
    known = F.transform(pair, lambda x: F.struct(x["a"].alias("a"), x["b"].alias("b"), F.array_distinct(F.concat(x["a"], x["b"])).alias("known")))

    def spelt(words, known):
        # code points from 1 on, without the surrogates
        code = lambda w: F.array_position(known, w) + F.when(F.array_position(known, w) >= 0xD800, 0x800).otherwise(0)
        return F.decode(F.unhex(F.array_join(F.transform(words, lambda w: F.lpad(F.hex(code(w)), 8, "0")), "")), "UTF-32")

    def near(x):
        most = slack(F.greatest(F.size(x["a"]), F.size(x["b"])))
        both = F.array(F.struct(spelt(x["a"], x["known"]).alias("a"), spelt(x["b"], x["known"]).alias("b"), most.alias("most")))

        def within(y):
            out = F.lit(False)
            for band in reversed(bands):
                distance = F.levenshtein(y["a"], y["b"], band).bitwiseAND(F.lit(0x7FFFFFFF))  # -1, beyond the band, becomes the largest
                out = F.when(y["most"] <= band, distance <= y["most"]).otherwise(out)
            return out

        fits = (F.abs(F.size(x["a"]) - F.size(x["b"])) <= most) & (F.size(x["known"]) < MOST_DISTINCT)
        return F.when(fits, F.element_at(F.transform(both, within), 1)).otherwise(False)

    return F.element_at(F.transform(known, near), 1)


def _unequal(u, v):
    return F.when(u == v, 0).otherwise(F.levenshtein(u, v))


def _in_order(x: str, y: str) -> Column:
    """What has to be edited of lines of equally many words, each held against the one in its place; null for others."""
    return F.when(F.size(x) == F.size(y), F.aggregate(F.zip_with(x, y, _unequal), F.lit(0), lambda t, c: t + c))


def _apart(a: str, b: str) -> Column:
    return F.bit_count(F.col(a).bitwiseXOR(F.col(b)))


def line_texts(docs: DataFrame, wanted: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, norm) of the wanted lines (id, doc_id, line_no, h; a written table)."""
    at = wanted.groupBy("doc_id").agg(F.collect_list(F.struct("id", "line_no", "h")).alias("wanted"))
    if wanted.count() <= BROADCAST_LINES:
        at = F.broadcast(at)
    rows = id_and_text(docs, id_col, text_col).join(at, "doc_id")
    both = F.array(F.struct(F.split("text", "\n").alias("lines"), F.col("wanted")))  # binds the split, so it is made once
    found = F.flatten(F.transform(both, lambda x: F.transform(x["wanted"], lambda w: F.struct(w["id"].alias("id"), w["h"].alias("h"), F.get(x["lines"], w["line_no"]).alias("line")))))
    texts = rows.select(F.explode(found).alias("x")).select("x.id", "x.h", parted(normalise(F.col("x.line"))).alias("norm"))
    # rows that share an id can hold another line at the place; the digest tells them apart
    return texts.where(F.unhex(F.md5("norm")) == F.col("h")).groupBy("id").agg(F.first("norm").alias("norm"))


def _verified(pairs: DataFrame, texts: DataFrame, similarity: float) -> DataFrame:
    """(u, v, ok) of pairs of lines (u, v): whether their texts (id, norm) are similar."""
    left, right = texts.select(F.col("id").alias("u"), F.col("norm").alias("norm_u")), texts.select(F.col("id").alias("v"), F.col("norm").alias("norm_v"))
    pairs = materialize(pairs.select("u", "v").distinct(), "line-pairs")
    both = pairs.join(left, "u").join(right, "v").repartition(1 + pairs.count() // PAIRS_A_TASK)  # dealt by number: comparing takes long, however few bytes there are
    return materialize(with_similar(both, "norm_u", "norm_v", similarity).select("u", "v", "ok"), "tested")


def _keyed(fps: DataFrame, radius: int) -> DataFrame:
    """(key, fp): each fingerprint under its pairs of blocks; the low bits of a key are 0, or in hot buckets the salt from 1 on."""
    key = F.explode(block_keys("fp", radius)).alias("key")
    sample = fps.where(F.pmod(F.xxhash64(F.lit(7), "fp"), F.lit(SAMPLE)) == 0)
    # a fingerprint is in as many buckets as there are pairs of blocks, so this share bounds the number of hot ones
    least = max(HOT_ROWS, int(sample.count() * HOT_SHARE))
    hot = sample.select(key).groupBy("key").agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") >= least).select("key", F.lit(True).alias("_hot"))
    hot = materialize(hot, "hot-buckets")
    keyed = fps.select(key, "fp")
    salt = F.lit(0)
    if hot.head(1):
        keyed = keyed.join(F.broadcast(hot), "key", "left")
        salt = F.when(F.col("_hot"), F.pmod(F.xxhash64("fp"), F.lit(SALTS)) + 1).otherwise(0)
    return keyed.select((F.col("key").cast("long") * (2 * SALTS) + salt).alias("key"), "fp")


SALTED = f"key % {2 * SALTS} > 0"


def _meetings(fps: DataFrame, radius: int, reach: int) -> tuple[DataFrame, DataFrame]:
    """Near fingerprints: (key, fp, pivot) of those near their bucket's pivot, and for hot buckets of all; (a, b) of others with any near one of their bucket."""
    w = Window.partitionBy("key")
    rows = _keyed(fps, radius).withColumn("pivot", F.min("fp").over(w)).withColumn("whole", F.count(F.lit(1)).over(w))
    rows = rows.withColumn("near", (F.col("fp") != F.col("pivot")) & (_apart("fp", "pivot") <= reach))
    rows = materialize(rows.where(f"near OR whole > 2 OR {SALTED}"), "buckets")
    few = rows.where(f"whole > 2 AND NOT {SALTED}")
    a, b = few.where("NOT near AND fp <> pivot").alias("a"), few.alias("b")
    on = (F.col("a.key") == F.col("b.key")) & (F.col("a.fp") != F.col("b.fp")) & (F.col("b.near") | (F.col("a.fp") < F.col("b.fp"))) & (_apart("a.fp", "b.fp") <= reach)
    pairs = a.join(b, on).select(F.greatest("a.fp", "b.fp").alias("a"), F.least("a.fp", "b.fp").alias("b")).distinct()
    return rows.where(f"near OR {SALTED}").select("key", "fp", "pivot"), pairs


def _tops(links: DataFrame, max_rounds: int = 50) -> DataFrame:
    """(node, component) of a forest of links (u, v) to parents, one for each u: pointers jump until all end at a top."""
    links = materialize(links, "jumps")
    for _ in range(max_rounds):
        up = links.select(F.col("u").alias("v"), F.col("v").alias("w"))
        new = materialize(links.join(up, "v", "left").select("u", F.coalesce("w", "v").alias("v"), F.col("w").isNotNull().alias("moved")), "jumps")
        if not new.where("moved").head(1):
            return new.select(F.col("u").alias("node"), F.col("v").alias("component"))
        links = new.select("u", "v")
    raise RuntimeError(f"links aren't a forest: pointers still move after {max_rounds} rounds")


def line_classes(docs: DataFrame, distinct: DataFrame, radius: int, reach: int, similarity: float, id_col: str, text_col: str) -> DataFrame:
    """(id, group) of lines of ``distinct`` (id, h, fp, len, place) that meet another: similar ones are connected."""
    lines = distinct.where("fp IS NOT NULL")
    fps = lines.groupBy("fp").agg(F.min("id").alias("rep"), F.count(F.lit(1)).alias("m"), F.min("len").alias("lo"), F.max("len").alias("hi"), F.min("words").alias("wlo"), F.max("words").alias("whi"))
    fps = materialize(fps, "fingerprints")
    bucketed, pairs = _meetings(fps.select("fp"), radius, reach)
    whole = F.col("key") - F.col("key") % (2 * SALTS)  # the bucket without its salt
    hot = bucketed.where(SALTED).groupBy(whole.alias("key")).agg(F.min("pivot").alias("_top"))
    bucketed = bucketed.withColumn("salted", F.expr(SALTED)).withColumn("key", whole).join(F.broadcast(hot), "key", "left").select("key", "salted", "fp", "pivot", F.coalesce("_top", "pivot").alias("top"))
    near = bucketed.select(F.col("fp").alias("a"), F.col("pivot").alias("b")).union(bucketed.where("salted").select("pivot", "top")).where((F.col("a") != F.col("b")) & (_apart("a", "b") <= reach))
    end = lambda x: fps.select(F.col("fp").alias(x), F.col("rep").alias(f"rep_{x}"), F.col("m").alias(f"m_{x}"), *[F.col(c).alias(f"{c}_{x}") for c in ("lo", "hi", "wlo", "whi")])
    sized = lambda lo, hi: (F.col(f"{hi}_a") >= F.floor(F.col(f"{lo}_b") * similarity)) & (F.col(f"{hi}_b") >= F.floor(F.col(f"{lo}_a") * similarity))
    like = sized("lo", "hi") | sized("wlo", "whi")
    near = materialize(near.union(pairs).distinct().join(end("a"), "a").join(end("b"), "b").where(like).select("a", "b", "rep_a", "rep_b", ((F.col("m_a") > 1) | (F.col("m_b") > 1)).alias("many")), "near")
    # from here on only lines that meet any: a small part of all, with their texts
    some = near.select(F.col("a").alias("fp")).union(near.select("b")).union(fps.where("m > 1").select("fp")).distinct()
    doc = F.floor(F.col("place") / F.lit(1 << 31)).cast("long")
    line = (F.col("place") - doc.cast("decimal(38,0)") * F.lit(1 << 31)).cast("int")
    lines = materialize(lines.join(some, "fp").select("id", "fp", doc.alias("doc_id"), line.alias("line_no"), "h"), "lines-met")
    fps = materialize(fps.join(some, "fp").select("fp", "rep", "m"), "fingerprints-met")
    texts = materialize(line_texts(docs, lines.drop("fp"), id_col, text_col), "line-texts")
    # each fingerprint's smallest partner first, and each line's first one of its fingerprint: a forest
    alike = lines.join(fps.where("m > 1").select("fp", "rep"), "fp").where("id <> rep").select(F.col("id").alias("u"), F.col("rep").alias("v"))
    parent = near.groupBy("a").agg(F.min(F.struct("b", "rep_a", "rep_b")).alias("x")).select(F.col("x.rep_a").alias("u"), F.col("x.rep_b").alias("v"))
    first = _verified(parent.union(alike), texts, similarity)
    found = _tops(first.where("ok").select("u", "v"))
    group = materialize(lines.join(found, lines["id"] == found["node"], "left").select("id", "fp", F.coalesce("component", "id").alias("group")), "groups")
    others = _either(near.select(F.col("rep_a").alias("u"), F.col("rep_b").alias("v"), _apart("a", "b").alias("bits")))
    others = others.join(_either(first), ["u", "v"], "left_anti")
    of = lambda x: group.select(F.col("id").alias(x), F.col("group").alias(f"g_{x}"))
    others = materialize(others.join(of("u"), "u").join(of("v"), "v").where("g_u <> g_v"), "others")
    group, second, joined = _settled(others, group, texts, similarity, True)
    others = _relabelled(others, joined)
    # what is left, by groups: lines near their bucket's pivot but not in its group, and lines that share a fingerprint
    classes = group.groupBy("fp", F.col("group").alias("root")).agg(F.count(F.lit(1)).alias("n"))
    theirs = classes.select(F.col("fp").alias("fp_b"), F.col("root").alias("root_b"))
    tops = fps.select(F.col("fp").alias("top"), "rep").join(group.select(F.col("id").alias("rep"), F.col("group").alias("top_root")), "rep").select("top", "top_root")
    wide = bucketed.select("key", "fp", "top").union(bucketed.select("key", F.col("pivot").alias("fp"), "top")).distinct().join(classes, "fp").join(tops, "top")
    wide = materialize(wide.select("key", "fp", "root", "top", "top_root"), "bucket-roots")
    a, b = wide.where("root <> top_root").alias("a"), wide.alias("b")
    ours = F.struct("a.fp", "a.root") < F.struct("b.fp", "b.root")
    on = (F.col("a.key") == F.col("b.key")) & (F.col("a.top") == F.col("b.top")) & (F.col("a.root") != F.col("b.root")) & (_apart("a.fp", "b.fp") <= reach) & ((F.col("b.root") == F.col("b.top_root")) | ours)
    met = a.join(b, on).select("a.fp", "a.root", F.col("b.fp").alias("fp_b"), F.col("b.root").alias("root_b"))
    many = near.where("many").select(F.col("a").alias("fp"), F.col("b").alias("fp_b")).join(classes.select("fp", "root"), "fp").join(theirs, "fp_b").where("root <> root_b")
    split = classes.join(fps.where("m > 1").select("fp", "rep"), "fp").join(group.select(F.col("id").alias("rep"), F.col("group").alias("rep_root")), "rep").where("root <> rep_root")
    same = split.select("fp", "root", F.col("fp").alias("fp_b")).join(theirs, "fp_b").where("root <> root_b")
    rest = met.unionByName(many.select("fp", "root", "fp_b", "root_b")).unionByName(same.select("fp", "root", "fp_b", "root_b")).distinct()
    own = group.select(F.col("id").alias("u"), "fp", F.col("group").alias("root"))
    theirs = group.select(F.col("id").alias("v"), F.col("fp").alias("fp_b"), F.col("group").alias("root_b"))
    rest = rest.join(own, ["fp", "root"]).join(theirs, ["fp_b", "root_b"])
    rest = _either(rest.select("u", "v", _apart("fp", "fp_b").alias("bits"), F.col("root").alias("g_u"), F.col("root_b").alias("g_v")))
    rest = rest.unionByName(others).distinct().join(_either(first.unionByName(second)), ["u", "v"], "left_anti")
    rest = materialize(rest, "rest")
    if rest.count() > MANY_LEFT:  # the rows are the same without this step, which connects most pairs by one of them
        group, _, joined = _settled(rest, group, texts, similarity, True)
        rest = _relabelled(rest, joined)
    return _settled(rest, group, texts, similarity, False)[0].select("id", "group")


def _either(pairs: DataFrame) -> DataFrame:
    """Pairs with the larger id first, and what else they have for both."""
    swap = lambda x, y: F.when(F.col("u") >= F.col("v"), F.col(x)).otherwise(F.col(y))
    more = [c for c in pairs.columns if c == "bits"] + ([swap("g_u", "g_v").alias("g_u"), swap("g_v", "g_u").alias("g_v")] if "g_u" in pairs.columns else [])
    return pairs.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"), *more)


def _relabelled(pairs: DataFrame, joined: DataFrame) -> DataFrame:
    """Pairs (u, v, bits, g_u, g_v) that still are of two groups after some were joined (node, component)."""
    for g in ("g_u", "g_v"):
        pairs = pairs.join(joined.select(F.col("node").alias(g), F.col("component").alias("_top")), g, "left").withColumn(g, F.coalesce("_top", g)).drop("_top")
    return pairs.where("g_u <> g_v").select("u", "v", "bits", "g_u", "g_v")


def _settled(pairs: DataFrame, group: DataFrame, texts: DataFrame, similarity: float, one: bool) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Groups (id, fp, group) after pairs (u, v, bits and their groups g_u, g_v) were verified, those that were, and which groups (node) became part of which (component); with ``one`` only the nearest pair of any two groups is."""
    now = pairs
    if one:
        now = now.groupBy(F.least("g_u", "g_v"), F.greatest("g_u", "g_v")).agg(F.min(F.struct("bits", "u", "v", "g_u", "g_v")).alias("x")).select("x.*")
    tested = _verified(now, texts, similarity)
    joined = connected_components(now.join(tested.where("ok"), ["u", "v"]).select(F.col("g_u").alias("u"), F.col("g_v").alias("v")))
    new = group.join(joined, group["group"] == joined["node"], "left").select("id", "fp", F.coalesce("component", "group").alias("group"))
    return materialize(new, "groups"), tested, joined


def line_groups(docs: DataFrame, min_words: int = MIN_WORDS, radius: int = RADIUS, reach: int = REACH, similarity: float = SIMILARITY, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, line_no, keep_doc, keep_line) of every line that has another occurrence, itself included."""
    seen = fingerprinted(docs, min_words, id_col, text_col)
    place = F.col("doc_id").cast("decimal(38,0)") * F.lit(1 << 31) + F.col("line_no")
    distinct = seen.groupBy("h", "fp", "len", F.col("n").alias("words")).agg(F.min(place.cast("decimal(38,0)")).alias("place"), F.count(F.lit(1)).alias("n"))
    distinct = materialize(distinct.withColumn("id", F.monotonically_increasing_id()), "distinct-lines")
    found = line_classes(docs, distinct, radius, reach, similarity, id_col, text_col)
    # a line that occurs once and meets none has no part in any group
    grouped = materialize(distinct.join(found, "id", "left").where("n > 1 OR group IS NOT NULL").select("h", "place", "n", F.coalesce("group", "id").alias("group")), "grouped")
    first = grouped.groupBy("group").agg(F.min("place").alias("keep"), F.sum("n").alias("whole")).where("whole > 1")
    keep_doc = F.floor(F.col("keep") / F.lit(1 << 31)).cast("long")
    keeps = grouped.join(first, "group").select("h", keep_doc.alias("keep_doc"), (F.col("keep") - keep_doc.cast("decimal(38,0)") * F.lit(1 << 31)).cast("int").alias("keep_line"))
    keeps = materialize(keeps, "line-keeps")
    return seen.join(keeps, "h").select("doc_id", "line_no", "keep_doc", "keep_line")


def line_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_lines, n_dropped, dropped (line numbers from 0, comma-joined).

    Null text counts as empty and is one empty line. Lines without a letter or
    digit are never dropped; lines of fewer than ``min_words`` words are dropped
    only for an equal one. Of a group the occurrence in the smallest document,
    then the smallest line, stays; equal lines of one document are occurrences
    like any other. Lines may be of any length. Rows that share an id count as
    one document and share the numbers; rows with a null id lose no line. Other
    columns are not read. An empty table gives an empty result.
    """
    groups = line_groups(docs, id_col=id_col, text_col=text_col, **options)
    drops = groups.where("doc_id <> keep_doc OR line_no <> keep_line").groupBy("doc_id").agg(F.array_sort(F.collect_set("line_no")).alias("gone"))
    rows = id_and_text(docs, id_col, text_col).select("doc_id", (F.octet_length("text") - F.octet_length(F.replace("text", F.lit("\n"), F.lit(""))) + 1).cast("long").alias("n_lines"))
    return rows.join(drops, "doc_id", "left").select(
        "doc_id",
        "n_lines",
        F.coalesce(F.size("gone").cast("long"), F.lit(0).cast("long")).alias("n_dropped"),
        F.coalesce(F.array_join(F.transform("gone", lambda x: x.cast("string")), ","), F.lit("")).alias("dropped"),
    )


def without_lines(docs: DataFrame, dedup: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with the dropped lines of ``line_dedup``'s result taken out of the text; columns and their names stay."""
    ident, lost = (f"{'_' * max(map(len, docs.columns))}_{c}" for c in ("id", "lost"))  # longer than any name there
    gone = dedup.where("n_dropped > 0").select(F.col("doc_id").alias(ident), F.split("dropped", ",").cast("array<int>").alias(lost)).dropDuplicates([ident])
    left = F.array_join(F.filter(F.split(F.col(text_col), "\n"), lambda x, i: ~F.array_contains(F.col(lost), i)), "\n")
    joined = docs.join(gone, docs[id_col].cast("long") == gone[ident], "left")
    return joined.withColumn(text_col, F.when(F.col(lost).isNull(), F.col(text_col)).otherwise(left)).drop(ident, lost)


def op5_line_dedup(spark, sf_dir: str) -> DataFrame:
    return line_dedup(table(spark, sf_dir, "documents"))
