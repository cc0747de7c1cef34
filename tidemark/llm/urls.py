"""URL filters: rules of hosts and paths, and gradient-boosted trees on lexical features for URLs that no rule fits.

The URLs that a rule decides are the labelled ones, from which the trees learn what the rules block and allow. Features are
lengths, depths, digits, entropy and parameters of a URL, and how many labelled URLs with the same ends (of the host, of
the file's name) and the same beginning of the path are blocked. These counts cover all labelled URLs and lie in a table
of fixed size by a hash; the trees are fitted on a bounded sample.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from math import log2

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import with_columns

_LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
#: Rows of the table of counts by suffix; it has one bounded size and is broadcast.
BUCKETS = 1 << 15
#: Labelled URLs that the trees are fitted on at most, drawn by a hash of the URL.
SAMPLE = 20_000
#: Labelled URLs that a suffix needs to weigh as much as the share of all.
PRIOR = 5.0


@dataclass(frozen=True)
class Rule:
    """Blocks or allows a host and all its subdomains where the path starts with the rule's."""

    verdict: str
    host: str
    path: str

    @property
    def name(self) -> str:
        return self.host + self.path


def host_and_path(url: str | None) -> tuple[str, str]:
    """What lies between :// and the next of / ? #, in lower case, and from there to the next of ? #; both empty without ://."""
    _, mark, rest = (url or "").partition("://")
    if not mark:
        return "", ""
    host_end = min((i for i in map(rest.find, "/?#") if i >= 0), default=len(rest))
    path_end = min((i for i in (rest.find(c, host_end) for c in "?#") if i >= 0), default=len(rest))
    return rest[:host_end].translate(_LOWER), rest[host_end:path_end]


class Rules:
    """Rules by host, the longest name first."""

    def __init__(self, rules: list[Rule]):
        self.by_host: dict[str, list[Rule]] = {}
        for r in sorted(rules, key=lambda r: (-len(r.name), r.name)):
            self.by_host.setdefault(r.host, []).append(r)

    def of(self, host: str, path: str) -> Rule | None:
        """The longest rule that fits."""
        best, at = None, 0
        while at >= 0:
            for r in self.by_host.get(host[at:], ()):
                if path.startswith(r.path) and (best is None or len(r.name) > len(best.name)):
                    best = r
            dot = host.find(".", at)
            at = dot + 1 if dot >= 0 else -1
        return best


def entropy(s: str) -> float:
    """Bits a character."""
    return sum(-n / len(s) * log2(n / len(s)) for n in sorted(Counter(s).values())) if s else 0.0


#: The features, in this order; after them one for each kind of suffix.
FEATURES = ("length", "host_length", "path_length", "labels", "depth", "digit_ratio", "host_digit_ratio", "entropy", "host_entropy", "parameters", "query_length", "fragment", "hyphens", "marks", "secure")
SUFFIXES = ("top", "domain", "host", "extension", "head")


def lexical(url: str | None, host: str, path: str) -> list[float]:
    """The values of FEATURES."""
    u = url or ""
    before, mark, fragment = u.partition("#")
    asked = before.partition("?")[2]
    digits = sum(c.isdigit() for c in u)
    return [
        len(u), len(host), len(path), host.count(".") + 1 if host else 0, path.count("/"), digits / len(u) if u else 0.0, sum(c.isdigit() for c in host) / len(host) if host else 0.0,
        entropy(u), entropy(host), sum(1 for p in asked.split("&") if p), len(asked), len(fragment) if mark else -1.0, host.count("-"), sum(u.count(c) for c in "%_~@=+"), float(u[:8].translate(_LOWER) == "https://"),
    ]


def suffixes(host: str, path: str) -> list[int]:
    """Buckets of the host's last label, its last two, all of it, the file's extension, and the path's first segment."""
    labels, last = host.split("."), path.rpartition("/")[2]
    parts = (labels[-1], ".".join(labels[-2:]), host, last.rpartition(".")[2] if "." in last else "", path.split("/")[1] if "/" in path else "")
    return [xxhash.xxh32_intdigest(f"{k}\0{v}".encode("utf-8", "surrogatepass"), 11) % BUCKETS for k, v in zip(SUFFIXES, parts)]


@dataclass(frozen=True)
class Trees:
    """Boosted trees of one depth: node i has the children 2i + 1 and 2i + 2, leaves come after all inner nodes."""

    base: float
    feature: np.ndarray  # trees by inner nodes
    cut: np.ndarray  # go right where the feature is greater
    leaf: np.ndarray  # trees by leaves

    def score(self, x: np.ndarray) -> np.ndarray:
        """Log odds by row."""
        rows, out = np.arange(len(x)), np.full(len(x), self.base)
        inner = self.feature.shape[1]
        for feature, cut, leaf in zip(self.feature, self.cut, self.leaf):
            at = np.zeros(len(x), dtype=np.int64)
            while len(at) and at[0] < inner:
                at = 2 * at + 1 + (x[rows, feature[at]] > cut[at])
            out += leaf[at - inner]
        return out


def fit_trees(x: np.ndarray, y: np.ndarray, rounds: int = 60, depth: int = 4, rate: float = 0.2, bins: int = 64, least: float = 1.0, ridge: float = 1.0) -> Trees:
    """Minimises the logistic loss by Newton steps; cuts lie between quantiles, and a split needs a positive gain.

    `least` is the second derivative that each side of a split has at least.
    """
    n, m = x.shape
    share = np.clip(y.mean() if n else 0.5, 1e-3, 1 - 1e-3)
    base, inner = float(np.log(share / (1 - share))), (1 << depth) - 1
    cuts = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, bins + 1)[1:-1], method="lower")) if n else np.zeros(0) for f in range(m)]
    width = max((len(c) for c in cuts), default=0) + 1
    placed = np.stack([np.searchsorted(c, x[:, f], side="left") for f, c in enumerate(cuts)], axis=1) if n else np.zeros((0, m), dtype=np.int64)
    score = np.full(n, base)
    features, values, leaves = [], [], []
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-score))
        g, h = p - y, p * (1 - p)
        feature, cut, at = np.zeros(inner, dtype=np.int32), np.full(inner, np.inf), np.zeros(n, dtype=np.int64)
        for level in range(depth):
            first, nodes = (1 << level) - 1, 1 << level
            where = at - first
            sums = [np.stack([np.bincount(where * width + placed[:, f], v, minlength=nodes * width).reshape(nodes, width) for f in range(m)], axis=1) for v in (g, h)]
            left = [s.cumsum(axis=2) for s in sums]
            whole = [s[:, :, -1:] for s in left]
            right = [w - s for w, s in zip(whole, left)]
            gain = left[0] ** 2 / (left[1] + ridge) + right[0] ** 2 / (right[1] + ridge) - whole[0] ** 2 / (whole[1] + ridge)
            gain[(left[1] < least) | (right[1] < least)] = 0
            for f, c in enumerate(cuts):
                gain[:, f, len(c) :] = 0
            best = np.round(gain, 9).reshape(nodes, -1).argmax(axis=1)
            for node, b in enumerate(best):
                f, c = divmod(int(b), width)
                if gain[node, f, c] > 1e-9:
                    feature[first + node], cut[first + node] = f, cuts[f][c]
            at = 2 * at + 1 + (x[np.arange(n), feature[at]] > cut[at])
        side = at - inner
        leaf = -rate * np.bincount(side, g, minlength=1 << depth) / (np.bincount(side, h, minlength=1 << depth) + ridge)
        score = score + leaf[side]
        features.append(feature)
        values.append(cut)
        leaves.append(leaf)
    return Trees(base, np.array(features).reshape(-1, inner), np.array(values).reshape(-1, inner), np.array(leaves).reshape(-1, 1 << depth))


_PARTS = [T.StructField(c, T.StringType()) for c in ("host", "path", "rule", "rule_verdict")]


def parsed(pages: DataFrame, rules: list[Rule], url: str = "url") -> DataFrame:
    """pages with host, path, and the name and verdict of the longest rule that fits, null where none does."""
    known = Rules(rules)

    def fill(batches: Iterator[pa.RecordBatch]) -> Iterator[list]:
        for b in batches:
            rows = []
            for u in b.column(b.schema.get_field_index(url)).to_pylist():
                host, path = host_and_path(u)
                r = known.of(host, path)
                rows.append((host, path, r and r.name, r and r.verdict))
            yield [pa.array([r[i] for r in rows], pa.string()) for i in range(4)]

    return with_columns(pages, url, _PARTS, fill)


@dataclass(frozen=True)
class UrlModel:
    """The trees and, by bucket, how many labelled URLs there are and how many of them are blocked."""

    trees: Trees
    labelled: np.ndarray
    blocked: np.ndarray
    share: float

    def rows(self, urls: list[str | None], hosts: list[str], paths: list[str], own: np.ndarray | None = None) -> np.ndarray:
        """Features by row; own: the verdicts of labelled rows (1: block), which their suffixes are to leave out."""
        if not urls:
            return np.zeros((0, len(FEATURES) + len(SUFFIXES)))
        bucket = np.array([suffixes(h, p) for h, p in zip(hosts, paths)])
        n, blocked = self.labelled[bucket], self.blocked[bucket]
        if own is not None:
            n, blocked = n - 1, blocked - own[:, None]
        rate = (blocked + PRIOR * self.share) / (n + PRIOR)
        return np.concatenate([np.array([lexical(u, h, p) for u, h, p in zip(urls, hosts, paths)], dtype=np.float64), rate], axis=1)

    def block_prob(self, urls: list[str | None], hosts: list[str], paths: list[str]) -> np.ndarray:
        return 1 / (1 + np.exp(-self.trees.score(self.rows(urls, hosts, paths))))


def train(labelled: DataFrame, sample: int = SAMPLE) -> UrlModel | None:
    """Fits labelled(url, host, path, rule_verdict); at most BUCKETS counts and `sample` URLs reach the driver. None without rows.

    A row of the sample does not count among its own suffixes. Repeated URLs count as often as they occur, but are drawn
    once. The result does not depend on how rows lie in tasks.
    """
    schema = T.ArrayType(T.IntegerType())

    def fill(batches: Iterator[pa.RecordBatch]) -> Iterator[list]:
        for b in batches:
            host, path = (b.column(b.schema.get_field_index(c)).to_pylist() for c in ("host", "path"))
            yield [pa.array([suffixes(h, p) for h, p in zip(host, path)], pa.list_(pa.int32()))]

    y = (F.col("rule_verdict") == "block").cast("long").alias("y")
    keyed = with_columns(labelled.select("url", "host", "path", y), "url", [T.StructField("buckets", schema)], fill)
    by_bucket = keyed.select("y", F.explode("buckets").alias("bucket")).groupBy("bucket").agg(F.count(F.lit(1)).alias("n"), F.sum("y").alias("blocked")).toPandas()
    if not len(by_bucket):
        return None
    n, blocked = np.zeros(BUCKETS), np.zeros(BUCKETS)
    n[by_bucket["bucket"]], blocked[by_bucket["bucket"]] = by_bucket["n"], by_bucket["blocked"]
    share = float(blocked.sum() / n.sum())
    drawn = labelled.select("url", "host", "path", y).groupBy("url").agg(F.min("host").alias("host"), F.min("path").alias("path"), F.min("y").alias("y"))
    rows = drawn.orderBy(F.xxhash64(F.lit(29), "url"), "url").limit(sample).collect()
    empty = UrlModel(Trees(0.0, np.zeros((0, 0), np.int32), np.zeros((0, 0)), np.zeros((0, 1))), n, blocked, share)
    own = np.array([r["y"] for r in rows], dtype=np.float64)
    x = empty.rows([r["url"] for r in rows], [r["host"] for r in rows], [r["path"] for r in rows], own)
    return UrlModel(fit_trees(x, own), n, blocked, share)


def judge(pages: DataFrame, rules: list[Rule], labelled: DataFrame | None = None, url: str = "url") -> DataFrame:
    """pages with host, path, rule, verdict ("allow" or "block") and block_prob (double).

    The longest rule that fits decides; other URLs are blocked where the trees, fitted on labelled(url, host, path,
    rule_verdict), by default the pages that rules decide, give a probability of one half or more. Without labelled rows
    nothing but rules blocks, and block_prob is null. A null or empty URL has an empty host and path and is judged by the
    trees as such. Repeated rows and URLs are judged alike, null and repeated page ids change nothing, and very long URLs
    take time in proportion to their length. Columns of other names pass through, those of these names are replaced; an
    empty table gives no rows. The rules, the trees and the counts by suffix are broadcast: their size doesn't grow with pages.
    """
    names = ("host", "path", "rule", "verdict", "block_prob")
    if labelled is None:
        labelled = parsed(pages.select(F.col(f"`{url}`").alias("url")), rules).where("rule_verdict IS NOT NULL")
    model, known = train(labelled), Rules(rules)
    shared = pages.sparkSession.sparkContext.broadcast(model)
    fields = [T.StructField(c, T.StringType()) for c in names[:4]] + [T.StructField(names[4], T.DoubleType())]

    def fill(batches: Iterator[pa.RecordBatch]) -> Iterator[list]:
        for b in batches:
            urls = b.column(b.schema.get_field_index(url)).to_pylist()
            parts = [host_and_path(u) for u in urls]
            hosts, paths = [p[0] for p in parts], [p[1] for p in parts]
            found = [known.of(*p) for p in parts]
            prob = shared.value.block_prob(urls, hosts, paths).tolist() if shared.value else [None] * len(urls)
            verdict = [r.verdict if r else "block" if p is not None and p >= 0.5 else "allow" for r, p in zip(found, prob)]
            yield [pa.array(x, pa.string()) for x in (hosts, paths, [r and r.name for r in found], verdict)] + [pa.array(prob, pa.float64())]

    return with_columns(pages, url, fields, fill)
