"""URL filters: rules, and gradient-boosted trees on lexical features. DataFrame functions only.

Features of a url are small whole numbers (bins), so labelled urls fold into one row per
distinct combination and label with a count. Each level of each tree is one aggregation of
that table: gradients, summed as whole millionths so that the order of rows can't matter, by
node, feature and bin. The driver sees those histograms (nodes x features x bins rows) and
picks the splits; the trees become CASE expressions, scored inside generated code.

Every labelled suffix has its own statistics. Those of the most frequent suffixes are a map
in the generated code; all others stay a table that rows are joined to.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from math import exp, log

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.llm._common import materialize

#: The rules of the query: (host, path prefix, verdict).
RULES = (
    ("org", "/", "allow"),
    ("example.org", "/es/", "block"),
    ("example.org", "/en/1", "block"),
    ("com", "/fr/", "allow"),
    ("com", "/de/", "block"),
)
TREES, DEPTH, RATE, L2, MIN_ROWS = 8, 3, 0.4, 1.0, 20
#: Bins of a feature, and suffixes (the most frequent ones) whose bins are in the generated code; the others' are joined.
BINS, SUFFIXES = 64, 256
#: Bytes of the other suffixes up to which they are broadcast, and parts that a suffix's rows are dealt into beyond.
BROADCAST_BYTES, SALTS = 4_000_000, 32
FEATURES = ("length", "host_length", "depth", "labels", "digits", "entropy", "params", "hyphens", "suffix")
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_URL = r"(?s)^.*?://([^/?#]*)([^?#]*)"


def host_of(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; else empty."""
    return F.translate(F.coalesce(F.regexp_extract(url, _URL, 1), F.lit("")), _UPPER, _LOWER)


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, _URL, 2), F.lit(""))


def rule_of(host: Column, path: Column, rules=RULES) -> Column:
    """The longest rule that fits, as host and path in one string; null if none does."""
    out = F.lit(None).cast("string")
    for h, p, _ in sorted(rules, key=lambda r: (len(r[0] + r[1]), r[0] + r[1])):
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        out = F.when(fits, F.lit(h + p)).otherwise(out)
    return out


def suffix_of(host: Column) -> Column:
    """The last two labels of a host."""
    return F.substring_index(host, ".", -2)


def _count(text: Column, ch: str) -> Column:
    return F.length(text) - F.length(F.replace(text, F.lit(ch), F.lit("")))


def _bin(x: Column) -> Column:
    return F.least(F.floor(x), F.lit(BINS - 1)).cast("int")


def features(url: Column, host: Column, path: Column, suffix_bin: Column) -> dict[str, Column]:
    """Lexical features of a url, each as a bin from 0 to BINS - 1."""
    u = F.coalesce(url, F.lit(""))
    n = F.length(u)
    step = lambda x: _bin(F.log2(x + 1) * 6)
    entropy = F.aggregate(
        F.transform(F.array_distinct(F.split(u, "")), lambda c: (n - F.length(F.replace(u, c, F.lit("")))) / n),
        F.lit(0.0),
        lambda acc, p: acc - F.when(p > 0, p * F.log2(p)).otherwise(0.0),
    )
    query = F.regexp_extract(u, r"(?s)\?([^#]*)", 1)
    return {
        "length": step(n),
        "host_length": step(F.length(host)),
        "depth": _bin(_count(path, "/")),
        "labels": _bin(_count(host, ".")),
        "digits": F.when(n > 0, _bin((n - F.length(F.translate(u, "0123456789", ""))) / n * BINS)).otherwise(0),
        "entropy": F.when(n > 0, _bin(entropy * 10)).otherwise(0),
        "params": _bin(_count(query, "=")),
        "hyphens": _bin(_count(host, "-")),
        "suffix": suffix_bin,
    }


@dataclass
class UrlModel:
    """Suffix bins, the bias, and trees as nested (feature, bin, left, right) with leaves as numbers.

    ``others`` has the bins of the suffixes that aren't in ``suffixes``, (s, b), or is None where there are none.
    """

    suffixes: dict[str, int] = field(default_factory=dict)
    others: DataFrame | None = None
    small: bool = True  #: whether ``others`` may be broadcast
    unseen: int = BINS // 2
    bias: float = 0.0
    trees: list = field(default_factory=list)

    def suffix_bin(self, host: Column, other: Column | None = None) -> Column:
        """The bin of a host's suffix; ``other`` is what a join with ``others`` found."""
        found = [] if other is None else [other]
        if self.suffixes:
            table = F.create_map(*[F.lit(x) for kv in sorted(self.suffixes.items()) for x in kv])
            found.insert(0, F.element_at(table, suffix_of(host)))
        return F.coalesce(*found, F.lit(self.unseen))

    def with_suffix_bin(self, rows: DataFrame, *salt: str) -> DataFrame:
        """``rows``, which have a column host, with their ``suffix_bin``; columns ``salt`` spread rows of one suffix."""
        if self.others is None:
            return rows.withColumn("suffix_bin", self.suffix_bin(F.col("host")))
        # Suffixes of the map need no join: they keep their rows apart, under a key that nothing matches.
        listed = suffix_of(F.col("host")).isin(list(self.suffixes))
        rows = rows.withColumn("__s", F.when(~listed, suffix_of(F.col("host"))))
        others = self.others.select(F.col("s").alias("__os"), F.col("b").alias("__ob"))
        if self.small:
            joined = rows.join(F.broadcast(others), F.col("__s") == F.col("__os"), "left")
        else:
            rows = rows.withColumn("__p", F.pmod(F.xxhash64(*salt), F.lit(SALTS)).cast("int"))
            others = others.withColumn("__op", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
            met = rows.where("__s is not null").join(others, (F.col("__s") == F.col("__os")) & (F.col("__p") == F.col("__op")), "left")
            apart = rows.where("__s is null").withColumn("__os", F.lit(None).cast("string")).withColumn("__ob", F.lit(None).cast("int"))
            joined = met.drop("__op", "__p").unionByName(apart.drop("__p"))
        return joined.withColumn("suffix_bin", self.suffix_bin(F.col("host"), F.col("__ob"))).drop("__s", "__os", "__ob")

    def margin(self, cols: dict[str, Column]) -> Column:
        total = F.lit(self.bias)
        for tree in self.trees:
            total = total + _tree(tree, cols)
        return total


def _tree(node, cols: dict[str, Column]) -> Column:
    if not isinstance(node, tuple):
        return F.lit(float(node))
    name, at, left, right = node
    return F.when(cols[name] <= at, _tree(left, cols)).otherwise(_tree(right, cols))


def _leaf_number(node, cols: dict[str, Column]) -> Column:
    """The leaf that a row reaches, numbered; -1 where the leaf is final."""
    if not isinstance(node, tuple):
        return F.lit(node if isinstance(node, int) else -1)
    name, at, left, right = node
    return F.when(cols[name] <= at, _leaf_number(left, cols)).otherwise(_leaf_number(right, cols))


def _best_split(hist: dict, g: int, h: int, n: int):
    """(gain, feature, bin, left sums, right sums) of the best split; hist[feature][bin] = (g, h, n) in millionths."""
    gain_of = lambda a, b: (a / 1e6) ** 2 / (b / 1e6 + L2)
    best = None
    for name in FEATURES:
        lg = lh = ln = 0
        for b in sorted(hist.get(name, {})):
            x, y, z = hist[name][b]
            lg, lh, ln = lg + x, lh + y, ln + z
            if ln < MIN_ROWS or n - ln < MIN_ROWS:
                continue
            gain = gain_of(lg, lh) + gain_of(g - lg, h - lh) - gain_of(g, h)
            if gain > 1e-6 and (best is None or gain > best[0]):
                best = (gain, name, b, (lg, lh, ln), (g - lg, h - lh, n - ln))
    return best


def fit_url_model(labelled: DataFrame, url_col: str = "url", label_col: str = "label") -> UrlModel:
    """Boosted trees from all rows of ``labelled``: label 1 for urls to block, 0 for others.

    All labelled urls and all their suffixes count; only the histograms and the statistics of
    the SUFFIXES most frequent suffixes come to the driver. Rows with a null label are not used; without rows
    of both labels the model is a constant.
    """
    spark = labelled.sparkSession
    y = F.col(label_col).cast("int")
    rows = labelled.where(y.isin(0, 1)).select(F.col(url_col).alias("url"), y.alias("y"))
    rows = rows.select("url", "y", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    stats = rows.groupBy(suffix_of(F.col("host")).alias("s")).agg(F.count(F.lit(1)).alias("n"), F.sum("y").alias("y"))
    top = stats.orderBy(F.desc("n"), "s").limit(SUFFIXES).collect()
    totals = stats.agg(F.sum("n").alias("n"), F.sum("y").alias("y")).first()
    n_all, y_all = totals["n"] or 0, totals["y"] or 0
    if not n_all or not 0 < y_all < n_all:
        return UrlModel(bias=0.0 if not n_all else (8.0 if y_all else -8.0))
    share = y_all / n_all
    as_bin = lambda s: min(BINS - 1, int(s * BINS))
    model = UrlModel(
        suffixes={r["s"]: as_bin((r["y"] + 10 * share) / (r["n"] + 10)) for r in top}, unseen=as_bin(share), bias=log(share / (1 - share))
    )
    if len(top) == SUFFIXES:
        b = F.least(F.lit(BINS - 1), F.floor((F.col("y") + 10 * share) / (F.col("n") + 10) * BINS)).cast("int")
        others = stats.where(~F.col("s").isin(list(model.suffixes))).select("s", b.alias("b"))
        others = materialize(others, "url-suffixes")
        told = others.agg(F.count(F.lit(1)).alias("n"), F.sum(F.octet_length("s") + 64).alias("bytes")).first()
        if told["n"]:
            model.others, model.small = others, told["bytes"] <= BROADCAST_BYTES
    cols = features(F.col("url"), F.col("host"), F.col("path"), F.col("suffix_bin"))
    binned = model.with_suffix_bin(rows, "url").select("y", *[c.alias(f) for f, c in cols.items()]).groupBy("y", *FEATURES).agg(F.count(F.lit(1)).alias("n"))
    binned = materialize(binned, "url-bins")
    cols = {f: F.col(f) for f in FEATURES}
    for _ in range(TREES):
        p = 1 / (1 + F.exp(-model.margin(cols)))
        graded = binned.withColumn("g", F.round((F.col("y") - p) * 1_000_000).cast("long") * F.col("n")).withColumn(
            "h", F.round(p * (1 - p) * 1_000_000).cast("long") * F.col("n")
        )
        tree, open_leaves, sums = 0, [0], {}
        for depth in range(DEPTH):
            at = graded.withColumn("leaf", _leaf_number(tree, cols)).where("leaf >= 0")
            long = at.select("leaf", "g", "h", "n", F.explode(F.array(*[F.struct(F.lit(f).alias("f"), F.col(f).alias("b")) for f in FEATURES])).alias("fb"))
            told = long.groupBy("leaf", "fb.f", "fb.b").agg(F.sum("g").alias("g"), F.sum("h").alias("h"), F.sum("n").alias("n")).collect()
            hists: dict = {}
            for r in told:
                hists.setdefault(r["leaf"], {}).setdefault(r["f"], {})[r["b"]] = (r["g"], r["h"], r["n"])
            replace, more = {}, []
            for leaf in open_leaves:
                hist = hists.get(leaf, {})
                if leaf not in sums:
                    first = hist.get(FEATURES[0], {})
                    sums[leaf] = tuple(sum(v[i] for v in first.values()) for i in range(3))
                best = _best_split(hist, *sums[leaf])
                if best is None:
                    replace[leaf] = _value(sums[leaf])
                    continue
                a, b = leaf * 2 + 1, leaf * 2 + 2
                sums[a], sums[b] = best[3], best[4]
                replace[leaf] = (best[1], best[2], a, b)
                more += [a, b]
            tree = _substitute(tree, replace)
            open_leaves = more
            if not more:
                break
        model.trees.append(_substitute(tree, {leaf: _value(sums[leaf]) for leaf in open_leaves}))
    return model


def _value(sums) -> float:
    g, h, _ = sums
    return RATE * (g / 1e6) / (h / 1e6 + L2)


def _substitute(node, by: dict):
    """The tree with its open leaves (whole numbers) replaced; settled leaves are floats."""
    if isinstance(node, tuple):
        return (node[0], node[1], _substitute(node[2], by), _substitute(node[3], by))
    return by.get(node, node) if isinstance(node, int) else node


def filter_urls(df: DataFrame, model: UrlModel, rules=RULES, id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """(page_id, host, path, rule, verdict, score) of every row: the longest fitting rule's verdict, else the model's.

    ``score`` is the model's probability of blocking, for every row. Map-only, unless the model
    has more suffixes than fit a broadcast: then rows of the less frequent ones are shuffled once.

    Defined results: a null url, or one without ``://``, has empty host and path, no rule, and
    is judged by the model on what text there is; null ids stay null; repeated rows each give
    a row with equal verdicts; an empty table gives none; other columns are not read.
    """
    url = F.col(url_col).cast("string")
    rows = df.select(F.col(id_col).cast("long").alias("page_id"), url.alias("url"), host_of(url).alias("host"), path_of(url).alias("path"))
    # Bins are columns of their own, so that each is computed once per row and not once per split.
    rows = model.with_suffix_bin(rows, "page_id", "url")
    rows = rows.withColumns(features(F.col("url"), F.col("host"), F.col("path"), F.col("suffix_bin")))
    score = 1 / (1 + F.exp(-model.margin({f: F.col(f) for f in FEATURES})))
    rows = rows.select("page_id", "host", "path", rule_of(F.col("host"), F.col("path"), rules).alias("rule"), score.alias("score"))
    verdict = F.when(F.col("score") > 0.5, "block").otherwise("allow")
    for h, p, v in rules:
        verdict = F.when(F.col("rule") == h + p, v).otherwise(verdict)
    return rows.select("page_id", "host", "path", "rule", verdict.alias("verdict"), F.round("score", 6).alias("score"))


def labelled_by_rules(df: DataFrame, rules=RULES, url_col: str = "url") -> DataFrame:
    """(url, label) of the rows that a rule fits: 1 where it blocks."""
    url = F.col(url_col).cast("string")
    rule = rule_of(host_of(url), path_of(url), rules)
    blocks = [h + p for h, p, v in rules if v == "block"]
    return df.select(url.alias("url"), rule.alias("rule")).where("rule is not null").select("url", F.col("rule").isin(blocks).cast("int").alias("label"))


def predict_in_python(model: UrlModel, bins: dict[str, int]) -> float:
    """The margin of one url from its bins; what the generated expression computes."""
    def walk(node):
        return float(node) if not isinstance(node, tuple) else walk(node[2] if bins[node[0]] <= node[1] else node[3])

    return model.bias + sum(walk(t) for t in model.trees)


def probability(margin: float) -> float:
    return 1 / (1 + exp(-margin))
