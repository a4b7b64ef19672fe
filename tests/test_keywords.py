import random

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from conftest import rows
from pyspark.sql import functions as F

from pulsewatch.operators import detect, keywords
from pulsewatch.plans import rule_queries

LOGS = "log string, resource string, seq long"
RULES = "rule_id string, resource string, op string, keyword string"


def tables(spark, seed=1, lines=80, many=120):
    pick = random.Random(seed)
    text = lambda n: "".join(pick.choice("abé ÿ\n%") for _ in range(n))
    logs = [(pick.choice([None, "", text(pick.randint(1, 40))]), pick.choice(["x", "y", None]), i) for i in range(lines)]
    logs += [(logs[5][0], "x", 900)] * 3 + [("ab" * 30_000 + "needle", "y", 901)]
    rules = [(f"r{i}", pick.choice([None, "x", "y"]), pick.choice(["like"] * 6 + ["=", "!=", "~", None]), pick.choice([text(pick.randint(0, 6)), None])) for i in range(many)]
    rules += [("needle", None, "like", "needle"), ("long", "y", "like", "abab" * 50), ("same", None, "=", logs[5][0]), ("same", None, "like", "a")]
    return spark.createDataFrame(logs, LOGS), spark.createDataFrame(rules, RULES)


@pytest.mark.parametrize("spread", [False, True])
def test_same_rows_as_testing_every_line(spark, spread):
    logs, rules = tables(spark)
    found = keywords.detect_keywords(logs, rules, spread=spread)
    want = detect.detect_logs(logs, rules)
    assert found.columns == want.columns
    assert rows(found) == rows(want)


def test_empty_tables(spark):
    logs, rules = tables(spark, 2, 10, 10)
    for spread in (False, True):
        assert keywords.detect_keywords(logs, rules.limit(0), spread=spread).collect() == []
        assert keywords.detect_keywords(logs.limit(0), rules, spread=spread).collect() == []


def test_few_keywords_are_looked_at(monkeypatch):
    """Of ten thousand keywords a line is searched for those whose n-gram it holds."""
    pick = random.Random(3)
    words = sorted({"".join(pick.choice("abcdefghijklmnop") for _ in range(10)) for _ in range(10_000)})
    rarest = [(int(keywords.keyword_grams(w.encode())[0]), w, w, None) for w in words]
    lookup = keywords.Lookup(rarest)
    line = f"some text with {words[77]} and nothing else".encode()
    looked = sum(len(lookup.keywords[i]) for i in lookup.near(line))
    assert list(lookup.hits(line, None)) == [words[77]] and looked < 20


def test_the_plan_has_no_test_of_every_rule(spark):
    logs, rules = tables(spark, 4)
    plan = keywords.detect_keywords(logs, rules.where("op = 'like' and keyword <> ''"), spread=False)
    text = plan._jdf.queryExecution().optimizedPlan().toString()
    assert "NestedLoop" not in text and "filter(" not in text.lower().replace("filter (", "")


@pytest.mark.parametrize("rules_at_once", [1, 7, 10_000])
def test_shares_of_rules_give_the_same_rows(spark, monkeypatch, rules_at_once):
    """Shares, blocks and hits of any size, with the columns asked for alone."""
    monkeypatch.setattr(keywords, "SHARE_RULES", rules_at_once)
    monkeypatch.setattr(keywords, "BLOCK", 37)
    monkeypatch.setattr(keywords, "OUT_BYTES", 1_000)
    logs, rules = tables(spark, 5)
    want = detect.detect_logs(logs, rules).select("rule_id", "seq")
    assert rows(keywords.detect_keywords(logs, rules, spread=True, columns=["seq"])) == rows(want)


def test_many_keywords_ship_neither_n_grams_nor_lines(spark):
    """Each line holds the rarest n-gram of each keyword, and no keyword: nothing but the rules is shuffled."""
    logs = spark.createDataFrame([("abcd bcde cdef " * 20 + str(i), None, i) for i in range(50)], LOGS)
    rules = spark.createDataFrame([(f"r{i}", None, "like", f"abcd{i:05d}") for i in range(200)], RULES)
    found = keywords.detect_keywords(logs, rules, spread=True)
    assert found.collect() == []
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "gram" not in plan and "_row" not in plan


def summed(found, column):
    """rule_id, rows, least value and sum, of rows that have a rule_id and a column that may be null."""
    out = {}
    for row in found.collect():
        out.setdefault(row["rule_id"], []).append(row[column])
    known = {k: [x for x in v if x is not None] for k, v in out.items()}
    return sorted((k, len(v), min(known[k], default=None), sum(known[k]) if known[k] else None) for k, v in out.items())


def added(parts):
    found = parts.groupBy("rule_id").agg(F.sum("hits"), F.min("first"), F.sum("total"))
    return sorted(tuple(r) for r in found.collect())


@pytest.mark.parametrize("spread", [False, True])
def test_totals_are_those_of_the_rows(spark, spread):
    """Rules of one keyword and several resources, rules with one id, and lines without a value."""
    logs, rules = tables(spark, 6)
    rules = rules.unionByName(rules.withColumn("resource", F.lit("y"))).unionByName(rules.withColumn("rule_id", F.concat("rule_id", F.lit("+"))))
    logs = logs.withColumn("seq", F.when(F.col("seq") % 5 != 0, F.col("seq") - 40))
    found = keywords.detect_keywords(logs, rules, spread=spread, totals="seq")
    assert found.dtypes == [("rule_id", "string"), ("hits", "bigint"), ("first", "bigint"), ("total", "bigint")]
    assert added(found) == summed(detect.detect_logs(logs, rules), "seq")


def test_totals_past_what_a_sum_holds_are_given_back_before(spark):
    big = 1 << 62
    logs = spark.createDataFrame([("a needle", None, x) for x in (big, -big, big, -big, 7, -(1 << 63), 5)], LOGS)
    rules = spark.createDataFrame([("r", None, "like", "needle")], RULES)
    parts = keywords.detect_keywords(logs.repartition(1), rules, spread=True, totals="seq").collect()
    assert sum(p["hits"] for p in parts) == 7 and sum(p["total"] for p in parts) == 12 - (1 << 63)
    assert min(p["first"] for p in parts) == -(1 << 63)


def share(rules, *within):
    columns = (pa.array([r[i] for r in rules], pa.string()) for i in range(3))
    return keywords.Share([pa.Table.from_arrays(list(columns), names=["keyword", "rule_id", "resource"])], *within)


def test_keywords_that_differ_in_one_byte_only():
    """Of 1 to 70 bytes, at any place, also at the end of a line and past it."""
    base = "".join(random.Random(7).choice("abcdefgh") for _ in range(70))
    words = sorted({base[:n] for n in range(1, 71)} | {base[:i] + "-" + base[i + 1 : n] for n in (3, 7, 8, 12, 19, 20, 21, 33, 70) for i in range(n)})
    known = share([(w, w, None) for w in words])
    lines = [base, base[:69], *words, "x" + base[:30] + "-" + base[31:], base[:40]]
    found = list(known.hits(pa.array(lines), pa.array([None] * len(lines), pa.string()), 1 << 20))
    got = sorted((int(n), known.rule_ids[int(r)].as_py()) for line, rule in found for n, r in zip(line, rule))
    assert got == sorted((n, w) for n, line in enumerate(lines) for w in words if w in line)


def test_rules_of_one_keyword_are_searched_for_once():
    known = share([("a needle", f"r{i}", ["x", None][i % 2]) for i in range(1000)])
    kind, line = known.kinds(pa.array(["hay", "a needle, a needle"]), pa.array(["x", "x"]))
    assert sorted(zip(kind.tolist(), line.tolist())) == [(0, 1), (1, 1)]


def test_a_place_is_looked_up_in_one_share():
    """However many tasks there are; so their work is reading the lines, and not looking all places up again."""
    pick = random.Random(8)
    words = pa.array(sorted({"".join(pick.choice("abcdefgh") for _ in range(14)) for _ in range(20_000)}))
    line = "".join(pick.choice("abcdefgh") for _ in range(50_000))
    data, ends = keywords.texts_of(pa.array([line]))
    slots = keywords.slots_of(words)
    of, ranges = keywords.dealing(np.bincount(slots, minlength=1 << keywords.SLOT_BITS).tolist(), 16)
    looked, sizes = 0, []
    for part, within in enumerate(ranges):
        own = words.filter(pa.array(of[slots, 0] == part))
        filed = share([(w, w, None) for w in own.to_pylist()], *within).filed
        looked += len(filed[0].near(keywords.eights(data), 0, len(line))[0])
        sizes.append(len(own))
    assert len(ranges) == 16 and looked <= len(line) and sum(sizes) == len(words) and max(sizes) < 1.1 * min(sizes)


def test_rules_with_one_head_are_divided():
    counts = [10] * 100 + [1000] + [0] * 27
    of, ranges = keywords.dealing(counts, 10)
    assert of[100].tolist() == [5, 5] and len(set(ranges[5:])) == 1 and len(ranges) == 10
    width = (1 << 32) // len(counts)
    assert all(ranges[f][0] <= i * width and (i + 1) * width - 1 <= sum(ranges[f]) for i, (f, w) in enumerate(of.tolist()) if counts[i])
    assert keywords.dealing([0] * 8, 4)[1] == []


def test_hot_heads_in_several_parts_give_the_same_rows(spark, monkeypatch):
    monkeypatch.setattr(keywords, "SHARE_RULES", 40)
    logs = spark.createDataFrame([(f"some text before a common head {i % 7} {i % 11}.", ["x", "y"][i % 2], i) for i in range(60)], LOGS)
    rules = [(f"r{i}", [None, "x"][i % 2], "like", f"a common head {i % 9} {i % 12}") for i in range(700)] + [("t", None, "like", "text")]
    rules = spark.createDataFrame(rules, RULES)
    want = detect.detect_logs(logs, rules)
    assert rows(keywords.detect_keywords(logs, rules, spread=True)) == rows(want)
    assert added(keywords.detect_keywords(logs, rules, spread=True, totals="seq")) == summed(want, "seq")


def test_keywords_out_of_odd_documents(spark, tmp_path):
    """The rules of log_rule_many out of empty, short, missing and non-ASCII texts are those of its SQL."""
    texts = ["", "a", None, "né à côté 漢字 🙂🙂 und so weiter " * 30, "x" * 12, "y" * 13, "z" * 14, "end\n" * 1500]
    docs = [(i if i != 6 else None, t, ["en", None, "fr"][i % 3], "s", 0) for i, t in enumerate(texts)]
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").coalesce(1).write.parquet(str(tmp_path / "documents.parquet"))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    want = con.execute(f"SELECT rule_id, resource, op, keyword FROM ({rule_queries.MANY_KEYWORDS_SQL})").fetchall()
    got = rule_queries.many_keywords(spark, str(tmp_path)).select("rule_id", "resource", "op", "keyword")
    assert rows(got) == sorted(want, key=repr)
