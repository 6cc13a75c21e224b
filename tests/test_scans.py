"""Scanners, plugins and the gateway on small rows."""

import datetime as dt
import time

import pytest
from pyspark.sql import functions as F

from laurel.operators import plugins as G
from laurel.operators import scanners as S
from laurel.operators import verify as V
from laurel.streaming import limits as L

MSG = "traj_id string, message_index int, role string, content string"


def test_matches_may_span_lines(spark):
    code = "x = 1\nsubprocess.call(a,\n  shell=True)\n\neval(x); eval (y)\n"
    rows = spark.createDataFrame([("a", code), ("b", "print(1)"), ("c", None), ("d", "")], "id string, code string")
    got = sorted((r["id"], r["rule"], r["line"]) for r in S.code_findings(rows, V.CODE_RULES).collect())
    assert got == [("a", "B307", 5), ("a", "B307", 5), ("a", "B602", 2)]
    audit = {r["id"]: (r["n_high"], r["passed"]) for r in S.audit(rows, V.CODE_RULES, "high").collect()}
    assert audit == {"a": (3, False), "b": (0, True), "c": (0, True), "d": (0, True)}
    assert all(r["passed"] for r in S.audit(rows, V.CODE_RULES, "low").collect())


@pytest.mark.parametrize(("code", "rule"), [("eval(input())", "B307"), ("subprocess.call('ls', shell=True)", "B602"), ("print('hi')", None), ("subprocess.run('ls', shell=True)", None), ("yaml.load(f)", None), ("yaml.load(f, Loader=None)", "B506"), ("random.choice", "B311")])
def test_code_rules(spark, code, rule):
    rows = spark.createDataFrame([("a", code)], "id string, code string")
    assert [r["rule"] for r in S.code_findings(rows, V.CODE_RULES).collect()] == ([rule] if rule else [])


def test_code_findings_are_linear_in_a_text(spark):
    def took(kilobytes, line):
        rows = spark.createDataFrame([("a", line * (kilobytes * 1000 // len(line)))], "id string, code string").cache()
        rows.count()
        began = time.perf_counter()
        n = S.code_findings(rows, V.CODE_RULES).count()
        return time.perf_counter() - began, n

    took(10, "x = 1\n")
    assert took(1000, "value = compute(other)  # é\n")[0] < 5
    assert took(1000, "print(eval(x))\n")[1] == 1_000_000 // 15
    small, large = (min(took(k, "value = compute(other)\n")[0] for _ in range(2)) for k in (500, 4000))
    assert large < 30 * small  # quadratic growth would make it 64 times


def test_code_findings_keep_other_columns(spark):
    rows = spark.createDataFrame([(1, "eval(a)\n\neval(b)", None, "k")], "id int, code string, n bigint, tag string")
    got = [tuple(r) for r in S.code_findings(rows, V.CODE_RULES).collect()]
    assert got == [(1, None, "k", "B307", "high", 1), (1, None, "k", "B307", "high", 3)]


def test_safety(spark):
    rows = [("ok", 0, "user", "drop table x", None), ("ok", 1, "assistant", "fine", ["{}"]), ("bad", 0, "tool", "we BYPASS  security; drop table", None), ("args", 0, "assistant", None, ["x", "rm -rf /"]), ("none", 0, "user", "malware", None)]
    got = {r["traj_id"]: (r["status"], r["message"]) for r in S.safety(spark.createDataFrame(rows, MSG + ", arguments array<string>")).collect()}
    assert got == {"ok": ("passed", "1 messages checked"), "bad": ("failed", "2 violations"), "args": ("failed", "1 violations"), "none": ("skipped", "nothing to check")}


def test_edge(spark):
    rows = [("secret", 0, "user", "password = 'hunter2'"), ("host", 0, "user", "hi"), ("host", 1, "assistant", "see http://10.0.0.1/x"), ("long", 0, "user", "y" * 50), ("role", 0, None, "x"), ("warn", 0, "assistant", "```\neval(x)\n```\n```js\na.innerHTML = 1\n```"), ("list", 0, "user", "TRUNCATE table t")]
    got = {r["traj_id"]: (r["passed"], r["reason"], r["n_warnings"]) for r in S.edge(spark.createDataFrame(rows, MSG), most=49 + 15).collect()}
    assert got["secret"] == (False, "policy: password", 0) and got["host"] == (False, "policy: blocked host", 0)
    assert got["role"] == (False, "format: no role", 0) and got["warn"] == (True, None, 2) and got["list"] == (False, "blocklist: blocked string", 0)
    assert got["long"] == (True, None, 0)


def test_runtime(spark):
    rows = [("good", 0, "assistant", "```python\nprint(1)\n```"), ("bad", 0, "assistant", "```py\nimport os\nos.system('x')\n```"), ("unrun", 0, "assistant", "```bash\nls\n```"), ("none", 0, "assistant", "text")]
    runs = spark.createDataFrame([("good", 0, "python", 0, 0, 3, 1), ("bad", 0, "python", 0, 0, 1, 0)], "traj_id string, message_index int, language string, block int, exit_code int, passed int, failed int")
    m = spark.createDataFrame(rows, MSG)
    assert {r["traj_id"]: (r["status"], r["modifier"]) for r in S.runtime(m, runs).collect()} == {"good": ("passed", 1.0), "bad": ("failed", -1.0), "unrun": ("failed", -1.0), "none": ("passed", 1.0)}
    assert {r["traj_id"]: r["modifier"] for r in S.runtime(m, runs, least=0.8).collect()}["good"] == -0.5
    assert {r["traj_id"]: r["status"] for r in S.runtime(m, runs, require_tests=True).collect()} == {"good": "passed", "bad": "failed", "unrun": "failed", "none": "passed"}


def test_policies_over_infrastructure(spark):
    rows = [("t", "terraform", "aws_s3_bucket", "b", '{"acl": "public-read", "tags": {"Environment": "x", "Owner": "y", "Project": "z"}}'), ("t", "terraform", "aws_ebs_volume", "v", '{"encrypted": false}'), ("u", "terraform", "aws_s3_bucket", "b", '{"acl": "private", "tags": {}}')]
    c = spark.createDataFrame(rows, "traj_id string, kind string, type string, name string, config string")
    assert sorted((r["traj_id"], r["rule"]) for r in S.policy_violations(c).collect()) == [("t", "encrypted_ebs"), ("t", "no_public_s3"), ("u", "tags_required")]
    assert {r["traj_id"]: r["status"] for r in S.policy(c).collect()} == {"t": "failed", "u": "passed"}
    assert {r["traj_id"]: r["status"] for r in S.policy(c, fail_on_warning=True).collect()} == {"t": "failed", "u": "failed"}


def test_plugins_by_name(spark):
    m = spark.createDataFrame([("a", 0, "assistant", "```python\nx = (\n```"), ("b", 0, "assistant", "malware")], MSG)
    rows = sorted((r["traj_id"], r["plugin"], r["status"]) for r in G.verified(m, ["safety_filter", "code_linter", "none"], skip={"safety_filter": F.col("traj_id") == "b"}).collect())
    assert rows == [("a", "code_linter", "failed"), ("a", "none", "error"), ("a", "safety_filter", "passed"), ("b", "code_linter", "skipped"), ("b", "none", "error")]
    got = {r["traj_id"]: (r["all_passed"], r["hard_failure"]) for r in G.composite(m, ["safety_filter"]).collect()}
    assert got == {"a": (True, False), "b": (False, True)}


def test_judges_and_rewards(spark):
    pairs = spark.createDataFrame([(1, "aaaa", "bb"), (2, "error", "x")], "pair_id int, answer_a string, answer_b string")
    assert {r["pair_id"]: (r["score_a"], r["score_b"]) for r in G.judged(pairs, "length").collect()} == {1: (8.0, 4.0), 2: (-990.0, 2.0)}
    s = spark.createDataFrame([(1, 0, 3.0, True), (1, 1, 5.0, True), (1, 2, 9.0, False)], "group_id int, idx int, score double, ok boolean")
    assert {r["idx"]: r["reward"] for r in G.rewarded(s, "rank", F.col("ok")).collect()} == {0: 0.0, 1: 1.0, 2: -1.0}
    assert {r["idx"]: r["reward"] for r in G.rewarded(s.filter("ok"), "zscore").collect()} == {0: -1.0, 1: 1.0}


def test_gateway(spark):
    t = lambda s: dt.datetime(2024, 1, 1, 0, 0, s)
    rows = [(1, 1, t(0), "known", "p", 5, 1, "ok"), (2, 1, t(1), "known", "p", 5, 1, "ok"), (3, 2, t(2), "unknown", "q", 5, 1, "ok"), (4, 2, t(3), "known", "r", 500, 1, "ok"), (5, 3, t(4), "known", "s", 5, 1, "timeout"), (6, 3, t(5), "known", "s", 5, 1, "ok"), (7, 3, t(6), "known", "s", 5, 1, "ok"), (8, 3, t(7), "known", "z", 5, 1, "ok")]
    req = spark.createDataFrame(rows, "request_id long, client_id long, ts timestamp, kind string, payload string, tokens int, variations int, outcome string")
    got = {r["request_id"]: (r["status"], r["by"]) for r in L.gateway(req, (("day", 3, 3, 86400),), 60, 100, 4, ("known",)).collect()}
    assert got == {1: ("completed", "ok"), 2: ("cached", "cache"), 3: ("failed", "unknown kind"), 4: ("failed", "tokens"), 5: ("timeout", "timeout"), 6: ("completed", "ok"), 7: ("cached", "cache"), 8: ("rate_limited", "day")}


def test_retries(spark):
    r = spark.createDataFrame([(1, 0), (2, 1), (3, 2)], "request_id int, start int")
    got = {x["request_id"]: (x["attempts"], x["endpoint"], x["ok"], x["waited"]) for x in L.retried(r, lambda a, e: (F.col("request_id") == 1) | ((F.col("request_id") == 2) & (e == 0)), 3).collect()}
    assert got == {1: (1, 0, True, 0.0), 2: (3, 0, True, 3.0), 3: (3, 1, False, 3.0)}


def test_prefixes_of_earlier_conversations(spark):
    m = lambda *x: [("user", c) for c in x]
    rows = [(1, m("a", "b", "c")), (2, m("a", "b", "d")), (3, m("a")), (4, [])]
    c = spark.createDataFrame(rows, "conv_id long, messages array<struct<role:string,content:string>>")
    entries = c.withColumn("messages", F.slice("messages", F.lit(1), F.greatest(F.size("messages") - 1, F.lit(0))))
    assert {r["conv_id"]: r["prefix"] for r in L.longest_prefix(c, entries).collect()} == {1: 0, 2: 2, 3: 0, 4: 0}
