"""URL filter: rules by host and path, and for what no rule decides gradient-boosted trees on lexical features.

Everything is DataFrame and SQL functions. Trees are grown level by level: one aggregate per level sums gradients per node,
feature and bin of the training rows, the driver reads that small table (nodes x features x bins) and picks the splits, and a
finished tree is a column expression. Gradients are summed as whole numbers, so that the trees don't depend on the order of rows.
"""
from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tideline.llm.common import stash

ALLOW, BLOCK = "allow", "block"
#: A url without a rule is blocked from this score on.
THRESHOLD = 0.5
#: Distinct labelled urls that the trees are grown on at most: those of the smallest hashes. Suffix statistics count all of them.
SAMPLE_ROWS = 20_000
TREES, DEPTH, RATE, BINS = 12, 3, 0.3, 16
#: Weight of the overall share in a suffix's share, rows that a leaf needs, and what leaf sums of second derivatives are raised by.
PRIOR, LEAF_ROWS, RIDGE = 4.0, 5, 1.0
FOLDS = 5
_UNIT = 1 << 24
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host, lower-cased from A to Z, and path of a url; both empty without ``://`` and for null."""
    at = F.locate("://", url)
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise("")
    host = F.translate(F.regexp_extract(rest, r"^([^/?#]*)", 1), _UPPER, _LOWER)
    return F.coalesce(host, F.lit("")), F.coalesce(F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1), F.lit(""))


@dataclass(frozen=True)
class Rule:
    """``at`` is a host and a path, as in ``example.net/en/``; it holds for subdomains and for paths that begin so."""

    verdict: str
    at: str

    @property
    def host(self) -> str:
        return self.at.partition("/")[0]

    @property
    def path(self) -> str:
        return "".join(self.at.partition("/")[1:])


def rule_of(host: Column, path: Column, rules: Sequence[Rule]) -> Column:
    """The longest rule that fits, else null; of equally long ones that with the longer host, then blocking goes before allowing.

    The rules become one expression, so they are a list that somebody writes, not a table."""
    fits = lambda r: ((host == r.host) | F.endswith(host, F.lit("." + r.host))) & F.startswith(path, F.lit(r.path))
    first = sorted(rules, key=lambda r: (-len(r.at), -len(r.host), r.verdict != BLOCK, r.at))
    return F.coalesce(F.lit(None).cast("string"), *[F.when(fits(r), F.lit(r.at)) for r in first])


def rule_verdict(rule: Column, rules: Sequence[Rule]) -> Column:
    first = sorted(rules, key=lambda r: r.verdict != BLOCK)
    return F.coalesce(F.lit(None).cast("string"), *[F.when(rule == r.at, F.lit(r.verdict)) for r in first])


def entropy(text: Column) -> Column:
    """Bits per character of a text's own distribution of characters; 0 of an empty one."""
    chars = F.array_sort(F.filter(F.split(text, ""), lambda c: c != ""))
    none = F.struct(F.lit("").alias("char"), F.lit(0).cast("bigint").alias("run"), F.lit(0.0).alias("sum"))
    weigh = lambda run: F.when(run > 1, run * F.log2(run.cast("double"))).otherwise(0.0)
    step = lambda acc, c: F.when(
        acc["char"] == c, F.struct(c.alias("char"), (acc["run"] + 1).alias("run"), acc["sum"].alias("sum"))
    ).otherwise(F.struct(c.alias("char"), F.lit(1).cast("bigint").alias("run"), (acc["sum"] + weigh(acc["run"])).alias("sum")))
    total = F.aggregate(chars, none, step, lambda acc: acc["sum"] + weigh(acc["run"]))
    n = F.length(text)
    return F.when(n > 0, F.greatest(F.lit(0.0), F.log2(n.cast("double")) - total / n)).otherwise(0.0)


def lexical_features(url: Column, host: Column, path: Column) -> dict[str, Column]:
    """Numbers that only the url's own characters decide."""
    url = F.coalesce(url, F.lit(""))
    count = lambda text, pattern: F.regexp_count(text, F.lit(pattern)).cast("double")
    share = lambda text, pattern: F.when(F.length(text) > 0, count(text, pattern) / F.length(text)).otherwise(0.0)
    asked = F.regexp_extract(url, r"^[^?#]*\?([^#]*)", 1)
    return {
        "length": F.length(url).cast("double"), "host_length": F.length(host).cast("double"), "depth": count(path, "[^/]+"),
        "labels": count(host, "[^.]+"), "hyphens": count(host, "-"), "digit_ratio": share(url, "[0-9]"), "host_digit_ratio": share(host, "[0-9]"),
        "entropy": entropy(url), "host_entropy": entropy(host), "parameters": count(asked, "[^&]+"), "secure": F.startswith(url, F.lit("https:")).cast("double"),
    }


def suffix(host: Column, labels: int) -> Column:
    """The last ``labels`` labels of a host."""
    return F.substring_index(host, ".", -labels)


#: Suffixes by their number of labels, and what the trees see.
SUFFIXES = (1, 2)
FEATURES = [
    "length", "host_length", "depth", "labels", "hyphens", "digit_ratio", "host_digit_ratio", "entropy", "host_entropy", "parameters", "secure",
    *(f"suffix_{k}" for k in SUFFIXES),
]


@dataclass(frozen=True)
class Node:
    """A split, rows up to ``edge`` to the left, or a leaf."""

    value: float = 0.0
    feature: int = -1
    bin: int = 0
    edge: float = 0.0
    left: "Node | None" = None
    right: "Node | None" = None


@dataclass(frozen=True)
class UrlModel:
    """``shares`` holds a suffix's share of blocked urls per number of labels; without trees nothing is blocked."""

    base: float
    share: float
    trees: list[Node]
    shares: dict[int, DataFrame]


def _walk(node: Node, goes_left) -> Column:
    if node.left is None or node.right is None:
        return F.lit(node.value)
    return F.when(goes_left(node), _walk(node.left, goes_left)).otherwise(_walk(node.right, goes_left))


def _margin(base: float, trees: Sequence[Node], goes_left) -> Column:
    total = F.lit(base)
    for tree in trees:
        total = total + _walk(tree, goes_left)
    return total


def best_split(cells: dict[tuple[int, int], tuple[int, int, int]], leaf_rows: int = LEAF_ROWS) -> tuple[float, int, int, tuple, tuple] | None:
    """Gain, feature, last bin of the left side and the sums of both sides, from sums (gradient, second derivative, rows) per
    (feature, bin) of a node; the first of equal gains, null if none is above zero."""
    worth = lambda g, h: (g / _UNIT) ** 2 / (h / _UNIT + RIDGE)
    best = None
    for feature in sorted({f for f, _ in cells}):
        bins = sorted(b for f, b in cells if f == feature)
        total = [sum(cells[feature, b][k] for b in bins) for k in range(3)]
        left = [0, 0, 0]
        for b in bins[:-1]:
            left = [x + y for x, y in zip(left, cells[feature, b])]
            right = [x - y for x, y in zip(total, left)]
            if min(left[2], right[2]) < leaf_rows:
                continue
            gain = worth(*left[:2]) + worth(*right[:2]) - worth(*total[:2])
            if gain > 1e-9 and (best is None or gain > best[0] + 1e-9):
                best = gain, feature, b, tuple(left), tuple(right)
    return best


def grow_trees(train: DataFrame, edges: list[list[float]], base: float, trees: int = TREES, depth: int = DEPTH, rate: float = RATE, leaf_rows: int = LEAF_ROWS) -> list[Node]:
    """Trees for ``train`` (label, bins: one whole number per feature, the edges below the value)."""
    by_bin = lambda node: F.col("bins")[node.feature] <= node.bin
    grown: list[Node] = []
    for _ in range(trees):
        chance = 1 / (1 + F.exp(-_margin(base, grown, by_bin)))
        whole = lambda x: F.round(x * _UNIT).cast("bigint")
        rows = train.select("bins", whole(F.col("label") - chance).alias("g"), whole(chance * (1 - chance)).alias("h"))
        splits: dict[int, tuple[int, int]] = {}
        values: dict[int, float] = {1: 0.0}
        for level in range(depth):
            place = lambda at=1: F.when(by_bin(Node(feature=splits[at][0], bin=splits[at][1])), place(2 * at)).otherwise(place(2 * at + 1)) if at in splits else F.lit(at)
            placed = rows.select(place().alias("node"), "g", "h", "bins").filter(F.col("node") >= 1 << level)
            sums = placed.select("node", "g", "h", F.posexplode("bins").alias("feature", "bin")).groupBy("node", "feature", "bin").agg(F.sum("g").alias("g"), F.sum("h").alias("h"), F.count("*").alias("n"))
            cells: dict[int, dict] = {}
            for r in sums.collect():  # at most 2**level nodes x features x bins
                cells.setdefault(r["node"], {})[r["feature"], r["bin"]] = (r["g"], r["h"], r["n"])
            found = False
            for at in sorted(cells):
                if split := best_split(cells[at], leaf_rows):
                    found, splits[at] = True, split[1:3]
                    for child, (g, h, _) in ((2 * at, split[3]), (2 * at + 1, split[4])):
                        values[child] = rate * (g / _UNIT) / (h / _UNIT + RIDGE)
            if not found:
                break
        if not splits:
            break
        made = lambda at: Node(feature=splits[at][0], bin=splits[at][1], edge=edges[splits[at][0]][splits[at][1]], left=made(2 * at), right=made(2 * at + 1)) if at in splits else Node(value=values[at])
        grown.append(made(1))
    return grown


def _share(blocked: Column, seen: Column, overall: float) -> Column:
    return (blocked + PRIOR * overall) / (seen + PRIOR)


def fit_urls(labelled: DataFrame, *, url_col: str = "url", label_col: str = "label", sample_rows: int = SAMPLE_ROWS, trees: int = TREES, depth: int = DEPTH) -> UrlModel:
    """Learn from urls labelled 1 (block) or 0 (allow).

    Null urls, other labels and urls with both labels are left out, repeated urls count once. With labels of one kind, or none,
    there are no trees. A training row's suffix shares come from the other folds, so that they mean there what they mean later."""
    label = F.col(label_col).cast("int")
    known = (
        labelled.select(F.col(url_col).alias("url"), label.alias("label")).filter(F.col("url").isNotNull() & F.col("label").isin(0, 1))
        .groupBy("url").agg(F.min("label").alias("label"), F.max("label").alias("other")).filter("label = other").drop("other")
    )
    host, path = host_and_path(F.col("url"))
    known = stash(known.select("url", "label", host.alias("host"), path.alias("path"), F.pmod(F.xxhash64("url", F.lit(1)), F.lit(FOLDS)).alias("fold")))
    size = known.agg(F.count("*").alias("n"), F.sum("label").alias("blocked")).first()
    if not size["n"] or size["blocked"] in (0, size["n"]):
        return UrlModel(0.0, 0.0, [], {})
    overall = size["blocked"] / size["n"]
    sample = known.orderBy(F.xxhash64("url"), "url").limit(sample_rows)
    shares = {}
    for k in SUFFIXES:
        counted = known.groupBy(suffix(F.col("host"), k).alias("suffix"), "fold").agg(F.sum("label").alias("blocked"), F.count("*").alias("seen"))
        counted = stash(counted)
        total = counted.groupBy(F.col("suffix").alias("of")).agg(F.sum("blocked").alias("all_blocked"), F.sum("seen").alias("all_seen"))
        shares[k] = stash(total.select(F.col("of").alias(f"of_{k}"), _share(F.col("all_blocked"), F.col("all_seen"), overall).alias(f"suffix_{k}")))
        others = counted.join(total, F.col("suffix") == F.col("of")).select(
            F.col("suffix").alias(f"of_{k}"), F.col("fold").alias(f"fold_{k}"), _share(F.col("all_blocked") - F.col("blocked"), F.col("all_seen") - F.col("seen"), overall).alias(f"suffix_{k}"))
        sample = sample.join(others, (suffix(F.col("host"), k) == F.col(f"of_{k}")) & (F.col("fold") == F.col(f"fold_{k}")), "left")
    made = lexical_features(F.col("url"), F.col("host"), F.col("path"))
    seen = stash(sample.select("label", *[(made[name] if name in made else F.col(name)).alias(name) for name in FEATURES]))
    at = F.array(*[F.lit(k / BINS) for k in range(1, BINS)])
    cuts = seen.agg(*[F.percentile(name, at).alias(name) for name in FEATURES]).first()
    edges = [sorted(set(cuts[name])) for name in FEATURES]
    below = lambda name, own: F.size(F.filter(F.array(*map(F.lit, own)), lambda e: e < F.col(name)))
    # one file of at most sample_rows rows: a level of a tree is one short task without a shuffle
    train = stash(seen.select("label", F.array(*[below(name, own) for name, own in zip(FEATURES, edges)]).alias("bins")).coalesce(1)).coalesce(1)
    base = math.log(overall / (1 - overall))
    return UrlModel(base, overall, grow_trees(train, edges, base, trees, depth), shares)


def url_filter(
    pages: DataFrame, rules: Sequence[Rule], model: UrlModel, *, id_col: str = "page_id", url_col: str = "url", threshold: float = THRESHOLD,
) -> DataFrame:
    """The id, ``host``, ``path``, ``rule``, ``verdict`` and ``score`` of every row.

    A rule that fits decides; without one the score does, which is the trees' probability of block (0 if there are no trees). A
    null url, or one without ``://``, has an empty host and path and is scored by what is left of it. Repeated rows are rows of
    their own, other columns are not looked at, an empty table gives an empty table."""
    rows = pages.select(F.col(id_col).alias("id"), F.col(url_col).alias("url"))
    host, path = host_and_path(F.col("url"))
    rows = rows.select("id", "url", host.alias("host"), path.alias("path"))
    score = F.lit(0.0)
    if model.trees:
        for k, table in model.shares.items():
            rows = rows.join(table, suffix(F.col("host"), k) == F.col(f"of_{k}"), "left")
        made = lexical_features(F.col("url"), F.col("host"), F.col("path"))
        rows = rows.select("id", "host", "path", *[(made[name] if name in made else F.coalesce(F.col(name), F.lit(model.share))).alias(name) for name in FEATURES])
        score = 1 / (1 + F.exp(-_margin(model.base, model.trees, lambda node: F.col(FEATURES[node.feature]) <= node.edge)))
    judged = rows.select("id", "host", "path", rule_of(F.col("host"), F.col("path"), rules).alias("rule"), score.alias("score"))
    by_score = F.when(F.col("score") >= threshold, BLOCK).otherwise(ALLOW)
    return judged.select(F.col("id").alias(id_col), "host", "path", "rule", F.coalesce(rule_verdict(F.col("rule"), rules), by_score).alias("verdict"), "score")
