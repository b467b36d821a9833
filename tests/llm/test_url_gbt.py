import re

from tests.llm.helpers import with_clashes
from tessera.llm import url_gbt as ug


def brute(url):
    if url is None or "://" not in url:
        return "", "", None
    rest = url.split("://", 1)[1]
    host = re.match(r"[^/?#]*", rest)[0]
    path = re.match(r"[^?#]*", rest[len(host) :])[0]
    host = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in host)
    fits = [r for r in ug.RULES if (host == r.split("/", 1)[0] or host.endswith("." + r.split("/", 1)[0])) and path.startswith("/" + r.split("/", 1)[1])]
    return host, path, max(fits, key=len, default=None)


URLS = [
    "http://a.com/x", "HTTPS://WWW.Example.com/en/1?q=2#f", "http://example.com/en/", "http://sub.example.com/en/x", "http://www.example.com/en", "http://net/es/1", "http://x.net/fr/2", "http://x.net/de/2",
    "http://b.org", "http://b.org?x=1", "nothing", "", None, "a://b://c/d", "http://É.com/ä", "http://xcom/", "x\n://h.com/p\nq", "http://u:p@h.com:80/en/",
]


def test_hosts_paths_rules_and_verdicts(spark):
    rows = [(i, u) for i, u in enumerate(URLS)] + [(100 + i, f"https://s{i}.example.com/en/{i}") for i in range(60)] + [(200 + i, f"http://good{i}.com/page/{i}") for i in range(60)] + [(300, "http://zz.example.org/en/7"), (301, "http://good.org/page/1")]
    pages = spark.createDataFrame(rows, "page_id long, url string")
    got = {r["page_id"]: r for r in ug.judged(spark, with_clashes(pages), ug.RULES).collect()}
    for i, u in rows:
        host, path, rule = brute(u)
        assert (got[i]["host"], got[i]["path"], got[i]["rule"]) == (host, path, rule), u
        assert got[i]["verdict"] == (ug.RULES[rule] if rule else got[i]["verdict"]) and got[i]["verdict"] in ("allow", "block")
    assert got[300]["verdict"] == "block" and got[301]["verdict"] == "allow"
    assert got[0]["verdict"] == "allow"


def test_one_verdict_no_labels_and_no_rows(spark):
    pages = spark.createDataFrame([(1, "http://a.org/x"), (2, "http://b.com/y")], "page_id long, url string")
    assert {r["verdict"] for r in ug.judged(spark, pages, {"com/": "block"}).collect()} == {"block"}
    assert {r["verdict"] for r in ug.judged(spark, pages, {"nowhere/": "block"}).collect()} == {"allow"}
    assert ug.judged(spark, pages.limit(0), ug.RULES).count() == 0


def test_trees_score_as_the_learner_does(spark):
    text = "GBT\n  Tree 0 (weight 1.0):\n    If (feature 0 <= 3.5)\n     If (feature 3 <= 1.0)\n      Predict: -1.0\n     Else (feature 3 > 1.0)\n      Predict: 0.5\n    Else (feature 0 > 3.5)\n     Predict: 1.0\n"
    (sql,) = ug.tree_sql(text)
    rows = spark.createDataFrame([(3.0, 1.0), (3.0, 2.0), (4.0, 0.0)], "n_url double, depth double").selectExpr(f"{sql} as y").collect()
    assert [r["y"] for r in rows] == [-1.0, 0.5, 1.0]


def test_verdicts_are_the_learners(spark):
    """The SQL expression against the fitted classifier itself, on other urls than it was fitted on."""
    from pyspark.ml.feature import VectorAssembler
    from pyspark.sql import functions as F

    pages = spark.read.parquet("/root/testdata/sf0.1/pages.parquet").select("page_id", "url")
    parts = ug.with_parts(pages).withColumn("rule", ug.rule_of(ug.RULES))
    labelled = parts.where("rule is not null").withColumn("label", F.when(F.col("rule").isin([r for r, v in ug.RULES.items() if v == "block"]), 1.0).otherwise(0.0))
    model, data = ug.training(spark, labelled)
    fitted = ug.learner().fit(data)
    features = model.with_shares(ug.with_features(parts))
    want = {r["page_id"]: r["prediction"] for r in fitted.transform(VectorAssembler(inputCols=list(ug.FEATURES), outputCol="features").transform(features)).select("page_id", "prediction").collect()}
    got = {r["page_id"]: r["verdict"] for r in ug.op8_url_filter(spark, "/root/testdata/sf0.1").where("rule is null").collect()}
    assert len(got) > 100 and all((got[i] == "block") == (want[i] == 1.0) for i in got)


def test_hot_urls_do_not_enlarge_the_sample(spark):
    from pyspark.sql import functions as F

    hot = [spark.range(50_000).select(F.lit(f"http://hot{k}.example.com/en/{k}").alias("url")) for k in range(4)]
    many = spark.range(30_000).select(F.concat(F.lit("http://a"), F.col("id").cast("string"), F.lit(".com/x")).alias("url"))
    rows = many
    for h in hot:
        rows = rows.unionByName(h)
    labelled = ug.with_parts(rows).withColumn("label", F.col("host").contains("example").cast("double"))
    few = ug.chosen(labelled)
    assert few.where("label = 1").count() == 4
    assert abs(few.where("label = 0").count() - ug.SAMPLE) < 600


def test_null_ids_repeated_rows_and_long_urls(spark):
    rows = [(None, "http://x.com/a"), (1, "http://y.org/en/1"), (1, "http://y.org/en/1"), (2, "http://l.org/" + "x/" * 60_000), (3, "http://z.net/es/1"), (None, None)]
    got = ug.judged(spark, spark.createDataFrame(rows, "page_id long, url string"), ug.RULES).collect()
    assert len(got) == 6 and sum(r["page_id"] is None for r in got) == 2
    assert len({r["verdict"] for r in got if r["page_id"] == 1}) == 1 and all(r["verdict"] in ("allow", "block") for r in got)
    assert max(len(r["path"]) for r in got) == 120_001
