"""URL rules and boosted trees beside plain versions."""

import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.llm import urls
from tidemark.llm.queries import QUERIES, RULES

DATA = "/root/testdata/sf0.1"


def plain_parts(url):
    m = re.search(r"://([^/?#]*)([^?#]*)", url or "", re.S)
    return ("".join(c.lower() if "A" <= c <= "Z" else c for c in m[1]), m[2]) if m else ("", "")


def plain_rule(host, path):
    fits = [r for r in RULES if (host == r.host or host.endswith("." + r.host)) and path.startswith(r.path)]
    return max(fits, key=lambda r: len(r.host + r.path), default=None)


ODD = (
    None, "", "no scheme", "http://", "HTTPS://A.EXAMPLE.NET/en/x", "https://example.net", "https://net/", "x://net?/a", "http://b.example.com/de/?q=http://c.org/fr/", "http://É.Org/fr/é%20",
    "ftp://fr.org/fr/", "http://myexample.com/de/", "http://example.com/de", "http://example.com:80/de/", "://net/", "http://a.net#/x", "http://.net/", "http://org/fr/" + "a" * 100_000,
)


def test_hosts_paths_and_rules(spark):
    rows = spark.createDataFrame([(i, u) for i, u in enumerate(ODD)], "page_id long, url string")
    got = {r["page_id"]: r for r in urls.judge(rows, RULES).collect()}
    for i, u in enumerate(ODD):
        host, path = plain_parts(u)
        rule = plain_rule(host, path)
        assert (got[i]["host"], got[i]["path"], got[i]["rule"]) == (host, path, rule and rule.host + rule.path), u
        assert got[i]["verdict"] == (rule.verdict if rule else "block" if got[i]["block_prob"] >= 0.5 else "allow")


def test_op12(spark, tmp_path):
    pages = spark.read.parquet(f"{DATA}/pages.parquet")
    rows = QUERIES["op12_boosted_url_filter"](spark, DATA).collect()
    given = {r["page_id"]: r["url"] for r in pages.select("page_id", "url").collect()}
    assert len(rows) == len(given)
    for r in rows:
        host, path = plain_parts(given[r["page_id"]])
        rule = plain_rule(host, path)
        assert (r["host"], r["path"], r["rule"]) == (host, path, rule and rule.name)
        assert r["verdict"] == (rule.verdict if rule else "block" if r["block_prob"] >= 0.5 else "allow")
    pages.repartition(5).write.parquet(f"{tmp_path}/pages.parquet")
    assert sorted(map(tuple, QUERIES["op12_boosted_url_filter"](spark, str(tmp_path)).collect())) == sorted(map(tuple, rows))


def test_labelled_urls_that_were_held_out_are_judged_well(spark):
    """Trained on the labelled URLs of four folds, judged on the fifth, as if no rule fitted those."""
    labelled = urls.parsed(spark.read.parquet(f"{DATA}/pages.parquet").select("url"), RULES).where("rule IS NOT NULL")
    fold = F.pmod(F.xxhash64("url"), F.lit(5))
    rows = urls.judge(labelled.where(fold == 0).select("url", "rule_verdict"), [], labelled.where(fold != 0)).collect()
    right = np.mean([r["verdict"] == r["rule_verdict"] for r in rows])
    most = max(np.mean([r["rule_verdict"] == v for r in rows]) for v in ("allow", "block"))
    assert len(rows) > 100 and right >= 0.9 and right > most + 0.1


def test_trees_score_as_a_walk_from_the_root():
    draw = np.random.default_rng(4)
    x = draw.normal(size=(500, 6)).round(1)
    y = ((x[:, 0] > 0.3) ^ (x[:, 2] > 0)).astype(float)
    trees = urls.fit_trees(x, y, rounds=30, depth=3)

    def walk(row):
        total = trees.base
        for feature, cut, leaf in zip(trees.feature, trees.cut, trees.leaf):
            at = 0
            while at < len(feature):
                at = 2 * at + 2 if row[feature[at]] > cut[at] else 2 * at + 1
            total += leaf[at - len(feature)]
        return total

    score = trees.score(x)
    assert score.tolist() == pytest.approx([walk(r) for r in x])
    assert np.mean((score > 0) == (y > 0)) > 0.97
    loss = [np.mean(np.log1p(np.exp(-np.where(y > 0, s, -s)))) for s in (urls.Trees(trees.base, trees.feature[:n], trees.cut[:n], trees.leaf[:n]).score(x) for n in range(0, 31, 5))]
    assert loss == sorted(loss, reverse=True)


def test_first_trees_take_the_best_single_cut():
    draw = random.Random(3)
    x = np.array([[draw.randrange(20), draw.randrange(20)] for _ in range(200)], dtype=float)
    y = (x[:, 1] > 11).astype(float)
    trees = urls.fit_trees(x, y, rounds=1, depth=1)
    assert trees.feature.tolist() == [[1]] and trees.cut.tolist() == [[11.0]]


def test_nulls_repeats_empty_tables_and_other_columns(spark):
    rows = spark.createDataFrame([(1, None, "a"), (1, None, "a"), (None, "http://x.net/", "b"), (2, "http://x.com/", None)], "page_id long, url string, own string").withColumns({c: F.lit("own") for c in ("host", "score", "labelled", "buckets", "y", "rule_verdict")})
    got = urls.judge(rows, RULES)
    found = got.collect()
    assert len(found) == 4 and all(r["score"] == r["labelled"] == r["buckets"] == r["y"] == r["rule_verdict"] == "own" for r in found)
    assert [r["verdict"] for r in found if r["rule"]] == ["block"] and {r["host"] for r in found} == {"", "x.net", "x.com"}
    assert urls.judge(rows.limit(0), RULES).collect() == []
    unlabelled = urls.judge(rows.where("page_id = 2"), RULES).collect()
    assert [(r["verdict"], r["block_prob"]) for r in unlabelled] == [("allow", None)]
