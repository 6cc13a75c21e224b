"""Configurations in texts and messages."""

import datetime as dt
import json

import pytest
from pyspark.sql import functions as F

from laurel.operators import configs as C

HCL = r'''
# a comment { with a brace
resource "aws_s3_bucket" "b" {
  acl    = "public-read" // why
  count  = var.n > 1 ? 2 : 1
  tags = { Environment = "prod", Owner : "me"
    "Project" = "p{q}" }
  versioning { enabled = true }
  lifecycle_rule { id = "a" }
  lifecycle_rule {
    id = "b"
    transition { days = 30 }
  }
  list = [1, 2.5, "x, ]", [true], {k = null},]
  policy = <<-EOT
    {"not": "parsed }"}
  EOT
  /* more
     text */
  ref = aws_x.y[0].id
  call = merge({a = 1}, local.t)
  url = "http://x//y" # tail
  esc = "a\"b\n"
  cond = "a" == var.b ? "c" : "d"
}
provider "aws" { region = "eu" }
resource "aws_s3_bucket" "c" {}
resource "aws_instance" "c" { ami = "x" }
'''


def test_nested_hcl():
    got = C.documents("hcl", HCL)[0]
    b = got["resource"]["aws_s3_bucket"]["b"]
    assert set(got) == {"resource", "provider"} and set(got["resource"]) == {"aws_s3_bucket", "aws_instance"} and got["resource"]["aws_s3_bucket"]["c"] == {}
    assert b["tags"] == {"Environment": "prod", "Owner": "me", "Project": "p{q}"}
    assert b["versioning"] == {"enabled": True} and b["lifecycle_rule"] == [{"id": "a"}, {"id": "b", "transition": {"days": 30}}]
    assert b["list"] == [1, 2.5, "x, ]", [True], {"k": None}] and b["policy"].strip() == '{"not": "parsed }"}'
    assert (b["count"], b["ref"], b["call"], b["url"], b["esc"], b["acl"], b["cond"]) == ("var.n > 1 ? 2 : 1", "aws_x.y[0].id", "merge({a = 1}, local.t)", "http://x//y", 'a"b\n', "public-read", '"a" == var.b ? "c" : "d"')


@pytest.mark.parametrize("bad", ["", "x", 'resource "a" "b" {', 'resource "a" "b" { x = }', 'resource "a" "b" { x = [1 }', "variable x { a = 1 }", "}", 'resource "a" = 1 2', "a" * 3 + "{" * 5000])
def test_no_hcl(bad):
    assert C.documents("hcl", bad) == []


YAML = """
# first
apiVersion: apps/v1
kind: Deployment
metadata: {name: web, labels: {app: "x: y", n: 1}, list: [a, 'b, c', [1, 2.5], {}]}
spec:
  replicas: 3
  empty:
  template:
    spec:
      hostNetwork: yes   # a comment
      containers:
      - name: a
        image: nginx:latest
        args: ["--x", "-y"]
        command:
          - sh
          - -c
          - |
            echo "a: b"
              # kept
            done
        env:
        - {name: K, value: 'it''s'}
        -
          name: url
          value: http://x:80/#frag
      -   name: b
          image: "b:1\\n"
          text: >-
            folded
            line

            next
          ratio: 0.5
          off_switch: Off
          port: 8080
          version: 1.2.3
          quoted: "123"
          none: ~
---
kind: Service
spec:
  ports: [
    80,
    443   # two
  ]
...
---
just text
"""


def test_yaml():
    docs = C.yaml_documents(YAML)
    assert len(docs) == 3 and docs[2] == "just text" and docs[1] == {"kind": "Service", "spec": {"ports": [80, 443]}}
    d = docs[0]
    assert d["metadata"] == {"name": "web", "labels": {"app": "x: y", "n": 1}, "list": ["a", "b, c", [1, 2.5], {}]}
    assert d["spec"]["replicas"] == 3 and d["spec"]["empty"] is None and d["spec"]["template"]["spec"]["hostNetwork"] is True
    a, b = d["spec"]["template"]["spec"]["containers"]
    assert a == {"name": "a", "image": "nginx:latest", "args": ["--x", "-y"], "command": ["sh", "-c", 'echo "a: b"\n  # kept\ndone\n'], "env": [{"name": "K", "value": "it's"}, {"name": "url", "value": "http://x:80/#frag"}]}
    assert b == {"name": "b", "image": "b:1\n", "text": "folded line\nnext", "ratio": 0.5, "off_switch": False, "port": 8080, "version": "1.2.3", "quoted": "123", "none": None}
    assert len(C.documents("yaml", YAML)) == 2


@pytest.mark.parametrize("bad", ["a: &x 1\nb: *x", "a: 1\n   b: 2", "a: [1, 2", "a: 'x", "\ta: 1", "a: 1\n- b", "x", "[1, 2]", "a: {b: 1}}", "a: !!str 1"])
def test_no_yaml(bad):
    assert C.documents("yaml", bad) == []


def test_json_round_trip_through_yaml_and_hcl():
    value = {"a": [1, "x", None, True, {"b": [[], {}]}], "c": {"d": 1.5, "e": ""}}
    lines = ["a:", "- 1", "- x", "-", "- true", "- b:", "  - []", "  - {}", "c:", "  d: 1.5", "  e: ''"]
    assert C.yaml_documents("\n".join(lines)) == [value]
    assert C.documents("k8s", json.dumps(value)) == [value] and C.documents("json", json.dumps(value)) == [value]


def test_parsers_are_linear():
    import time

    def took(n):
        began = time.process_time()
        assert len(C.documents("hcl", "".join(f'resource "t" "r{i}" {{\n  a = "x"\n  b {{ c = [1, 2] }}\n  d = var.x\n}}\n' for i in range(n)))[0]["resource"]["t"]) == n
        assert len(C.documents("yaml", "items:\n" + "".join(f"  - name: n{i}\n    v: [1, 2]\n" for i in range(n)))[0]["items"]) == n
        return time.process_time() - began

    took(100)
    assert took(8000) < 40 * max(took(500), 0.01)  # quadratic growth would make it 256 times


def test_resources_of_plain_texts(spark):
    rows = spark.createDataFrame([(1, 'resource "aws_ebs_volume" "v" {\n  encrypted = false\n  size = 3\n  zones = ["a", "b"]\n}'), (2, "nothing"), (3, None)], "traj_id int, text string")
    got = [(*r[:3], json.loads(r["config"])) for r in C.resources(rows).collect()]
    assert got == [(1, "aws_ebs_volume", "v", {"encrypted": False, "size": 3, "zones": ["a", "b"]})]


MSG = "traj_id string, message_index int, role string, content string"


def test_messages(spark):
    rows = [
        ("hcl", 0, "user", f"please\n```HCL\n{HCL}```\nand\n```tf\nbroken {{\n```"),
        ("yaml", 1, "assistant", f"```yaml\n{YAML}```"),
        ("json", 0, "user", '```json\n{"resource": {"aws_ebs_volume": {"v": {"encrypted": false}}}}\n```\n```json\n{"kind": "Pod", "spec": {"containers": []}}\n```\n```json\n{"x": 1}\n```\n```json\n[1]\n```'),
        ("good", 0, "user", '```terraform\nresource "aws_subnet" "s" { tags = {Environment = "a", Owner = "b", Project = "c"} }\n```'),
        ("none", 0, "user", "```python\nprint(1)\n```"),
        ("null", 0, "user", None),
    ]
    m = spark.createDataFrame(rows, MSG)
    got = sorted((r["traj_id"], r["message_index"], r["kind"], r["type"], r["name"]) for r in C.configurations(C.extracted(m)).collect())
    assert got == [
        ("good", 0, "terraform", "aws_subnet", "s"),
        ("hcl", 0, "terraform", "aws_instance", "c"),
        ("hcl", 0, "terraform", "aws_s3_bucket", "b"),
        ("hcl", 0, "terraform", "aws_s3_bucket", "c"),
        ("json", 0, "generic", "", ""),
        ("json", 0, "kubernetes", "Pod", "unnamed"),
        ("json", 0, "terraform", "aws_ebs_volume", "v"),
        ("yaml", 1, "kubernetes", "Deployment", "web"),
        ("yaml", 1, "kubernetes", "Service", "unnamed"),
    ]
    certificates = {r["traj_id"]: (r["n_violations"], r["status"], r["expires"]) for r in C.message_certificates(m, F.lit("2024-01-01").cast("timestamp_ntz")).collect()}
    assert {k: v[1] for k, v in certificates.items()} == {"hcl": "non_compliant", "yaml": "non_compliant", "json": "compliant", "good": "compliant", "none": "unknown", "null": "unknown"}
    assert certificates["good"] == (0, "compliant", dt.datetime(2024, 1, 2)) and certificates["none"] == (0, "unknown", None)
    verdicts = {r["traj_id"]: (r["status"], r["message"]) for r in C.message_policy(m).collect()}
    assert verdicts["none"] == verdicts["null"] == ("passed", "no configuration") and verdicts["good"] == ("passed", "0 errors, 0 warnings")
    assert verdicts["json"][0] == verdicts["hcl"][0] == verdicts["yaml"][0] == "failed"
