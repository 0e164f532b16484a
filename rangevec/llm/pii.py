"""Personal data by candidate generation and gradient boosting, with DataFrame functions on the main path.

Base rules find spans of four kinds. Generators of high recall propose more,
overlapping ones: parts of longer digit runs, looser writings. Boosted trees
score each candidate by its format and its surroundings, and per-kind thresholds,
calibrated on held-out candidates to a precision, select what is added.

The trees are fitted on the driver from a bounded sample of candidates (about
``sample`` of them, by a hash) and become one SQL expression, so scoring stays in
the JVM and moves no rows. Labels are distant: a candidate that is a base span
is right; one that is a run the base rule dropped, or has a base span's kind but
other borders, is wrong. What base rules never see is taught by rewriting:
sampled base spans are written otherwise within their surroundings (other signs
for @ and dots, a number before a card, no country code), and candidates with the
rewritten borders are right, others that overlap it wrong.

Spans never cross a match's own characters, and positions come from the lengths
of what lies between matches, all in code points.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rangevec.llm.common import id_and_text, table
from rangevec.sources.scratch import materialize

KINDS = ("email", "ip", "card", "phone")
_LOCAL = "[A-Za-z0-9._%+-]"
_LABEL = "[A-Za-z0-9-]"
_OCTET = "0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])"
_EMPTY = "cast(array() as array<struct<k:int,s:int,e:int,v:string>>)"

#: The base rules, written so that Java's matcher takes linear time: the same leftmost matches, without retries inside a run.
BASE = (
    rf"(?:\G|(?<!{_LOCAL})){_LOCAL}++@{_LABEL}++(?:\.{_LABEL}++)++",
    r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}",
    r"[0-9]++(?:[ -][0-9]++)*+",
    r"\+[0-9][ ().0-9-]+[0-9]",
)
#: Texts without one of these have no base match of the kind.
TELL = ("@", r"[0-9]\.[0-9]+\.[0-9]", r"[0-9](?:[ -]?[0-9]){11}", r"\+[0-9]")
#: (kind, pattern) of candidates beyond the base matches.
GENERATORS = (
    (0, rf"(?<!{_LOCAL}){_LOCAL}++ ?(?:@|\(at\)|\[at\]) ?{_LABEL}++(?: ?(?:\.|\(dot\)|\[dot\]) ?{_LABEL}++)*+"),
    (1, r"(?<![0-9])[0-9]{1,3}(?:\.[0-9]{1,3}){3}(?![0-9])"),
    (2, r"(?<![0-9A-Za-z])[0-9]{4}([ -]?)[0-9]{4}\1[0-9]{4}\1[0-9]{4}(?![0-9A-Za-z])"),
    (2, r"(?<![0-9A-Za-z])3[47][0-9]{2}([ -]?)[0-9]{6}\1[0-9]{5}(?![0-9A-Za-z])"),
    (2, r"(?<![0-9A-Za-z])[0-9]{12,19}(?![0-9A-Za-z])"),
    (3, r"\+[0-9]{1,3} \([0-9]{3}\) [0-9]{3}-[0-9]{4}(?![0-9])"),
    (3, r"\+[0-9]{1,3}[ .-]?(?:\([0-9]{1,4}\)[ .-]?)?[0-9]{2,4}(?:[ .-][0-9]{2,4}){1,3}(?![0-9]|\.[0-9])"),
    (3, r"(?<![0-9A-Za-z+])\([0-9]{3}\) ?[0-9]{3}[ .-][0-9]{4}(?![0-9])"),
)
SAMPLE = 4000
PRECISION = 0.95
_CONTEXT = "(?i)(?:tel|phone|call|mobile|fax|card|visa|credit|mail|contact|addr|host|server)[^a-z]*$"


def matches(text: str, pattern: str, kind: int, tell: str | None = None) -> Column:
    """All leftmost matches in a text column, as structs of kind, start, end and value."""
    found, gaps = F.regexp_extract_all(F.col(text), F.lit(pattern), F.lit(0)), F.split(F.col(text), pattern, -1)
    both = F.arrays_zip(found.alias("v"), F.slice(gaps, 1, F.size(found)).alias("g"))
    start = F.expr(f"named_struct('at', 0, 'out', {_EMPTY})")

    def step(acc, x):
        s = acc["at"] + F.length(x["g"])
        e = s + F.length(x["v"])
        one = F.struct(F.lit(kind).alias("k"), s.alias("s"), e.alias("e"), x["v"].alias("v"))
        return F.struct(e.alias("at"), F.concat(acc["out"], F.array(one)).alias("out"))

    all_ = F.aggregate(both, start, step, lambda acc: acc["out"])
    return F.when(F.col(text).rlike(tell or pattern), all_).otherwise(F.expr(_EMPTY))


_DIGITS = "translate({v}, translate({v}, '0123456789', ''), '')"


def _luhn(d: str) -> str:
    digit = f"int(substring({d}, -i, 1))"
    return f"aggregate(sequence(1, length({d})), 0, (a, i) -> a + CASE WHEN i % 2 = 1 THEN {digit} WHEN {digit} > 4 THEN 2 * {digit} - 9 ELSE 2 * {digit} END) % 10 = 0"


def _valid(x: str) -> str:
    """SQL: whether a match of its kind passes the base rule's tests."""
    d = _DIGITS.format(v=f"{x}.v")
    octets = rf"^{_OCTET}(?:\\.{_OCTET}){{3}}$"
    return (
        f"CASE {x}.k WHEN 0 THEN true WHEN 1 THEN {x}.v rlike '{octets}' "
        f"WHEN 2 THEN CASE WHEN length({d}) BETWEEN 12 AND 19 THEN {_luhn(d)} ELSE false END "
        f"ELSE length({d}) BETWEEN 9 AND 15 END"
    )


def _kind_of(char: str) -> str:
    return f"CASE WHEN {char} = '' THEN 0D WHEN {char} rlike '[0-9]' THEN 4D WHEN {char} rlike '[\\\\p{{L}}]' THEN 3D WHEN {char} rlike '\\\\s' THEN 1D ELSE 2D END"


def _features(c: str) -> list[str]:
    """SQL of a candidate's features: what it looks like and what stands around it."""
    d = _DIGITS.format(v=f"{c}.v")
    octets = rf"^{_OCTET}(?:\\.{_OCTET}){{3}}$"
    char = lambda at, ok: f"CASE WHEN {ok} THEN substring(text, {at}, 1) ELSE '' END"
    count = lambda what: f"double(length({c}.v) - length(replace({c}.v, '{what}', '')))"
    return [
        f"double({c}.k)",
        f"double({c}.e - {c}.s)",
        f"double(length({d}))",
        f"double(size(split({c}.v, '[^0-9]+')))",
        count(" "),
        count("-"),
        count("."),
        count("("),
        count("@"),
        f"CASE WHEN {c}.v rlike '(@|at[^a-z]).*([.]|dot)' THEN 1D ELSE 0D END",
        f"CASE WHEN {c}.v LIKE '+%' THEN 1D ELSE 0D END",
        f"CASE WHEN length({d}) BETWEEN 12 AND 19 THEN CASE WHEN {_luhn(d)} THEN 1D ELSE 0D END ELSE -1D END",
        f"CASE WHEN {c}.v rlike '{octets}' THEN 1D ELSE 0D END",
        _kind_of(char(f"{c}.s", f"{c}.s > 0")),
        _kind_of(char(f"{c}.s - 1", f"{c}.s > 1")),
        _kind_of(char(f"{c}.e + 1", "true")),
        _kind_of(char(f"{c}.e + 2", "true")),
        f"CASE WHEN length({d}) > 0 THEN double(substring({d}, 1, 1)) ELSE -1D END",
        f"CASE WHEN substring(text, greatest(1, {c}.s - 23), least({c}.s, 24)) rlike '{_CONTEXT}' THEN 1D ELSE 0D END",
    ]


def _spans(docs: DataFrame) -> DataFrame:
    """base: what the base rules keep; dropped: what they find and drop."""
    found = docs.select("*", *[matches("text", p, k, tell).alias(f"_m{k}") for k, (p, tell) in enumerate(zip(BASE, TELL))])
    found = found.withColumn("_all", F.concat(*[f"_m{k}" for k in range(4)])).drop(*[f"_m{k}" for k in range(4)])
    found = found.withColumn("_told", F.expr(f"transform(_all, x -> struct(x.k, x.s, x.e, x.v, {_valid('x')} AS ok))")).drop("_all")
    return found.withColumn("base", F.expr("filter(_told, x -> x.ok)")).withColumn("dropped", F.expr("filter(_told, x -> NOT x.ok AND length(x.v) > 5)")).drop("_told")


def _candidates(spans: DataFrame) -> DataFrame:
    """cands: candidates that are no base span, and base spans, with features and a distant label (null: undecided)."""
    gate = F.col("text").contains("@") | F.col("text").rlike(r"\(at\)|\[at\]|[0-9][ ().0-9-]{5}")
    more = F.concat(*[matches("text", p, k) for k, p in GENERATORS])
    found = spans.withColumn("_more", F.when(gate, more).otherwise(F.expr(_EMPTY)))
    every = "array_distinct(concat(_more, transform(concat(base, dropped), x -> struct(x.k, x.s, x.e, x.v))))"
    found = found.withColumn("_every", F.expr(every)).drop("_more")
    label = (
        "CASE WHEN exists(base, b -> b.k = c.k AND b.s = c.s AND b.e = c.e) THEN 1D "
        "WHEN exists(base, b -> b.k = c.k AND b.s < c.e AND c.s < b.e) THEN 0D "
        "WHEN exists(dropped, b -> b.k = c.k AND b.s = c.s AND b.e = c.e) THEN 0D END"
    )
    return found.withColumn("cands", F.expr(f"transform(_every, c -> struct(c.k, c.s, c.e, {label} AS y, array({', '.join(_features('c'))}) AS f))")).drop("_every")


def _tree(x: np.ndarray, g: np.ndarray, h: np.ndarray, depth: int, least: int = 5):
    """A regression tree on gradients: a leaf's value, or (feature, cut, left, right)."""
    leaf = float(-g.sum() / (h.sum() + 1.0))
    if depth == 0 or len(x) < 2 * least:
        return leaf
    best, gain = None, 1e-6
    whole = g.sum() ** 2 / (h.sum() + 1.0)
    for j in range(x.shape[1]):
        order = np.argsort(x[:, j], kind="stable")
        v, gs, hs = x[order, j], np.cumsum(g[order]), np.cumsum(h[order])
        cut = np.flatnonzero(v[1:] > v[:-1])
        cut = cut[(cut + 1 >= least) & (len(v) - cut - 1 >= least)]
        if len(cut):
            won = gs[cut] ** 2 / (hs[cut] + 1) + (gs[-1] - gs[cut]) ** 2 / (hs[-1] - hs[cut] + 1) - whole
            i = int(np.argmax(won))
            if won[i] > gain:
                gain, best = won[i], (j, float(v[cut[i]] + v[cut[i] + 1]) / 2)
    if best is None:
        return leaf
    left = x[:, best[0]] <= best[1]
    return (*best, _tree(x[left], g[left], h[left], depth - 1, least), _tree(x[~left], g[~left], h[~left], depth - 1, least))


def _apply(tree, x: np.ndarray) -> np.ndarray:
    if not isinstance(tree, tuple):
        return np.full(len(x), tree)
    j, cut, left, right = tree
    return np.where(x[:, j] <= cut, _apply(left, x), _apply(right, x))


def _sql(tree, rate: float) -> str:
    if not isinstance(tree, tuple):
        return f"{tree * rate:.9e}D"
    return f"CASE WHEN c.f[{tree[0]}] <= {tree[1]:.6f}D THEN {_sql(tree[2], rate)} ELSE {_sql(tree[3], rate)} END"


class Scorer:
    """Boosted trees and, for each kind, the score from which a candidate is selected (infinite: never)."""

    def __init__(self, trees: list, bias: float, cuts: list[float], rate: float) -> None:
        self.trees, self.bias, self.cuts, self.rate = trees, bias, cuts, rate

    def expression(self) -> str:
        return " + ".join([f"{self.bias:.9e}D", *(_sql(t, self.rate) for t in self.trees)])


def fit(x: np.ndarray, y: np.ndarray, precision: float = PRECISION, rounds: int = 30, depth: int = 3, rate: float = 0.3) -> Scorer:
    """Fit on two thirds of the rows; calibrate on the rest the score from which the wanted precision holds."""
    rng = np.random.default_rng(5)
    fold = rng.integers(0, 3, len(y)) == 0
    if not y.any() or y.all() or fold.all() or not fold.any() or not (~fold & (y > 0)).any():
        return Scorer([], 0.0, [np.inf] * len(KINDS), rate)
    a, b = x[~fold], y[~fold]
    bias = float(np.log((b.sum() + 0.5) / (len(b) - b.sum() + 0.5)))
    z, trees = np.full(len(b), bias), []
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-z))
        trees.append(_tree(a, p - b, p * (1 - p), depth))
        z += rate * _apply(trees[-1], a)
    held = bias + rate * sum(_apply(t, x[fold]) for t in trees)
    cuts = []
    for k in range(len(KINDS)):
        mine = x[fold][:, 0] == k
        order = np.argsort(-held[mine], kind="stable")
        s, right = held[mine][order], y[fold][mine][order].cumsum()
        share = (right + 0.5) / (np.arange(len(s)) + 1.5)
        last = np.append(s[1:] < s[:-1], True) if len(s) else np.zeros(0, bool)
        good = np.flatnonzero(last & (share >= precision - 0.5 / (np.arange(len(s)) + 1.5)) & (right > 0))
        if len(good):
            below = s[good[-1] + 1] if good[-1] + 1 < len(s) else s[good[-1]] - 1
            cuts.append(max(0.0, float(s[good[-1]] + below) / 2))  # midway, clear of rounding
        else:
            cuts.append(np.inf)
    return Scorer(trees, bias, cuts, rate)


# How a base span may be written otherwise, by a hash's remainder: what stands for @ and for a dot, what may stand before a card.
AT_SIGNS, DOTS, BEFORE_CARD = (" (at) ", "(at)", " [at] ", " @ "), (".", " (dot) ", "[dot]", "."), "27 "
WINDOW = 60


def _rewritten(windows: DataFrame) -> DataFrame:
    """(doc_id, text, k, s, e, y): windows (k, v, before, after, h) with the span written as the base rules don't read it, and where it stands; y = 0 where what stands there is none.

    Emails get other signs, phones lose their country code, cards follow upon
    another number.
    """
    pick = lambda values: F.element_at(F.array(*map(F.lit, values)), (F.pmod("h", F.lit(len(values))) + 1).cast("int"))
    local, domain = F.substring_index("v", "@", 1), F.substring_index("v", "@", -1)
    email = F.concat(local, pick(AT_SIGNS), F.replace(domain, F.lit("."), pick(DOTS)))
    phone = F.regexp_replace("v", r"^\+[0-9]{1,3}[ .-]?", "")
    new = F.when(F.col("k") == 0, email).when(F.col("k") == 3, phone).otherwise(F.col("v"))
    lead = F.when(F.col("k") == 2, F.lit(BEFORE_CARD)).otherwise(F.lit(""))
    yes = windows.where("k <> 1").select("*", new.alias("new"), lead.alias("lead"), F.lit(1.0).alias("y"))
    # a sign between any two words of the surroundings makes no email
    no = windows.where("k = 0").withColumn("before", F.rtrim("before")).withColumn("after", F.ltrim("after"))
    no = no.select("*", F.concat(F.lit(" "), F.trim(pick(AT_SIGNS)), F.lit(" ")).alias("new"), F.lit("").alias("lead"), F.lit(0.0).alias("y"))
    start = F.length("before") + F.length("lead")
    return yes.union(no).select("doc_id", F.concat("before", "lead", "new", "after").alias("text"), "k", start.alias("s"), (start + F.length("new")).alias("e"), "y", "h")


def _retold(windows: DataFrame) -> DataFrame:
    """(h, y, f) of candidates at rewritten spans: right if they have its borders, wrong if they overlap it otherwise or it is none."""
    found = _candidates(_spans(_rewritten(windows).select("doc_id", "text", F.struct("k", "s", "e", "y", "h").alias("t"))))
    y = "CASE WHEN c.s = t.s AND c.e = t.e THEN t.y ELSE 0D END"
    cands = f"transform(filter(cands, c -> (c.y IS NULL OR c.y = 0) AND c.k = t.k AND c.s < t.e AND t.s < c.e), c -> struct(t.h AS h, {y} AS y, c.f AS f))"
    return found.select(F.explode(F.expr(cands)).alias("x")).select("x.h", "x.y", "x.f")


def train(docs: DataFrame, sample: int = SAMPLE, precision: float = PRECISION, id_col: str = "doc_id", text_col: str = "text") -> Scorer:
    """Fit the scorer on about ``sample`` labelled candidates of ``docs`` and as many rewritten base spans, chosen by a hash.

    One pass over the texts writes the labelled candidates and the base spans
    with ``WINDOW`` characters to both sides; both samples are drawn from what is written.
    """
    cands = _candidates(_spans(id_and_text(docs, id_col, text_col)))
    own = "transform(filter(cands, c -> c.y IS NOT NULL), c -> struct(c.k AS k, c.s AS s, c.e AS e, c.y AS y, c.f AS f, cast(null as string) AS v, cast(null as string) AS before, cast(null as string) AS after))"
    around = f"transform(base, b -> struct(b.k AS k, b.s AS s, b.e AS e, cast(null as double) AS y, cast(null as array<double>) AS f, b.v AS v, substring(text, greatest(1, b.s - {WINDOW - 1}), least(b.s, {WINDOW})) AS before, substring(text, b.e + 1, {WINDOW}) AS after))"
    rows = cands.select("doc_id", F.explode(F.expr(f"concat({own}, {around})")).alias("c"))
    rows = rows.select("doc_id", F.pmod(F.xxhash64("doc_id", "c.s", "c.e", "c.k"), F.lit(1 << 30)).alias("h"), "c.*")
    rows = materialize(rows, "pii-candidates")

    def some(part: DataFrame) -> DataFrame:
        total = part.count()
        return part if total <= sample else part.where(F.col("h") < max(1, int((1 << 30) * sample / total)))

    got = some(rows.where("y IS NOT NULL")).select("h", "y", "f")
    again = _retold(some(rows.where("y IS NULL")).select("doc_id", "k", "v", "before", "after", "h"))
    got = got.unionByName(again).toPandas()
    if not len(got):
        return Scorer([], 0.0, [np.inf] * len(KINDS), 0.3)
    got = got.assign(shown=got["f"].map(lambda f: tuple(f))).sort_values(["h", "y", "shown"])
    return fit(np.stack(got["f"].map(np.asarray)), got["y"].to_numpy(), precision)


def find_pii(docs: DataFrame, scorer: Scorer, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, text, base and added: arrays of spans (k: index into KINDS, s, e in code points); added ones have a score z.

    A candidate that the base rule has not judged is added if it reaches its kind's threshold, overlaps no base
    span of its kind, and no better candidate of its kind overlaps it (ties: the
    earlier, then the longer).
    """
    base = _spans(id_and_text(docs, id_col, text_col))
    if not any(np.isfinite(scorer.cuts)):
        return base.select("doc_id", "text", "base", F.expr("cast(array() as array<struct<k:int,s:int,e:int,z:double>>)").alias("added"))
    found = _candidates(base)
    found = found.withColumn("_z", F.expr(f"transform(filter(cands, c -> c.y IS NULL AND NOT exists(base, b -> b.k = c.k AND b.s < c.e AND c.s < b.e)), c -> struct(c.k, c.s, c.e, {scorer.expression()} AS z))"))
    reach = " ".join(f"WHEN {k} THEN c.z >= {cut:.9e}D" for k, cut in enumerate(scorer.cuts) if np.isfinite(cut))
    found = found.withColumn("_in", F.expr(f"filter(_z, c -> CASE c.k {reach} ELSE false END)"))
    better = "(o.z > c.z OR o.z = c.z AND (o.s < c.s OR o.s = c.s AND o.e > c.e))"
    return found.select("doc_id", "text", "base", F.expr(f"filter(_in, c -> NOT exists(_in, o -> o.k = c.k AND o.s < c.e AND c.s < o.e AND {better}))").alias("added"))


def _shown(spans: str) -> Column:
    names = "array(" + ", ".join(f"'{k}'" for k in KINDS) + ")"
    return F.expr(f"array_join(transform(array_sort(transform({spans}, x -> struct(x.s, x.k, x.e))), x -> concat({names}[x.k], ':', x.s, ':', x.e)), ',')")


def scan_pii(docs: DataFrame, scorer: Scorer | None = None, **options) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans.

    The counts and the digest are of the base spans, spans lists those and the
    added ones as kind:start:end. Null and empty texts have none. Repeated rows
    and null ids each give a row. Other columns are not read. An empty table, or
    one without candidates of both labels, adds nothing.
    """
    found = find_pii(docs, train(docs, **options) if scorer is None else scorer, **options)
    counts = [F.expr(f"size(filter(base, x -> x.k = {k}))").cast("long").alias(f"n_{name}") for k, name in enumerate(KINDS)]
    return found.select("doc_id", *counts, F.sha2(_shown("base").cast("binary"), 256).alias("base_sha256"), _shown("concat(transform(base, x -> struct(x.k, x.s, x.e)), transform(added, x -> struct(x.k, x.s, x.e)))").alias("spans"))


def redact(found: DataFrame, mark: str = "[{}]") -> DataFrame:
    """doc_id and text of ``find_pii``'s rows with each run of overlapping spans replaced by the mark of its first kind."""
    names = "array(" + ", ".join("'" + mark.format(k.upper()) + "'" for k in KINDS) + ")"
    spans = "array_sort(transform(concat(transform(base, x -> struct(x.k, x.s, x.e)), transform(added, x -> struct(x.k, x.s, x.e))), x -> struct(x.s, x.k, x.e)))"
    step = (
        "(acc, x) -> CASE WHEN x.s >= acc.at THEN named_struct('at', x.e, 'out', concat(acc.out, substring(text, acc.at + 1, x.s - acc.at), "
        f"{names}[x.k])) ELSE named_struct('at', greatest(acc.at, x.e), 'out', acc.out) END"
    )
    return found.select("doc_id", F.expr(f"aggregate({spans}, named_struct('at', 0, 'out', ''), {step}, acc -> concat(acc.out, substring(text, acc.at + 1, length(text))))").alias("text"))


def op8_pii(spark, sf_dir: str) -> DataFrame:
    return scan_pii(table(spark, sf_dir, "documents"))
