"""Infrastructure configurations in messages: fenced blocks of HCL, YAML and JSON, parsed to variants and taken apart to resources and manifests.

Blocks are found by the fences, in columns; only what is inside them goes through a parser, in Arrow batches. A block that does not parse is no
configuration. Of YAML, block and flow collections, quoted, plain and block scalars, comments and several documents are read; anchors, aliases and tags are not.
In HCL, expressions that are more than a literal stay as their text; a block that stands once is a map, and one that is repeated a list of maps.
"""

from __future__ import annotations

import json
import re

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import written
from . import scanners as S

# The languages of fences.
TERRAFORM, KUBERNETES = ("terraform", "hcl", "tf"), ("yaml", "kubernetes", "k8s")
_FENCES = f"(?is)```({'|'.join([*TERRAFORM, *KUBERNETES, 'json'])})\\s*\\n(.*?)```"

# ---- HCL ---------------------------------------------------------------------------------------------------------------

_SKIP = re.compile(r"(?:\s+|(?:#|//)[^\n]*|/\*.*?\*/)+", re.S)
_NAME = re.compile(r"[A-Za-z_][\w-]*|\"(?:[^\"\\\n]|\\.)*\"")
_STRING = re.compile(r"\"(?:[^\"\\\n]|\\.)*\"")
_HEREDOC = re.compile(r"<<-?(\w+)[^\S\n]*\n(.*?)^[^\S\n]*\1[^\S\n]*$", re.S | re.M)
_REST = re.compile(r"[^\S\n]*(?=[\n,\]}#]|//|/\*|\Z)")
_RAW = re.compile(r"[^\n,\[\](){}\"#]+|#|//[^\n]*")
_NUMBER = re.compile(r"-?\d+(?:\.\d+)?(?:[eE][-+]?\d+)?\Z")
_OPEN = {"[": "]", "(": ")", "{": "}"}


class Hcl:
    """A recursive-descent reader of one text; every position is read once, or twice where a literal turns out to begin an expression."""

    def __init__(self, text: str):
        self.text, self.at = text, 0

    def skip(self) -> str:
        """The next character that means something, or the empty string."""
        if m := _SKIP.match(self.text, self.at):
            self.at = m.end()
        return self.text[self.at : self.at + 1]

    def take(self, what: re.Pattern) -> str:
        m = what.match(self.text, self.at)
        if not m:
            raise ValueError(f"unexpected text at {self.at}")
        self.at = m.end()
        return m.group()

    def body(self, end: str) -> dict:
        out, repeated = {}, set()
        while (c := self.skip()) != end:
            if not c:
                raise ValueError("a block is not closed")
            names = [_unquoted(self.take(_NAME))]
            while (c := self.skip()) not in ("=", "{", ""):
                names.append(_unquoted(self.take(_NAME)))
            if not c:
                raise ValueError("a name without a value")
            self.at += 1
            if c == "=":
                if len(names) > 1:
                    raise ValueError("several names before a value")
                out[names[0]] = self.value()
                continue
            inner, place = self.body("}"), out
            self.at += 1
            for name in names[:-1]:
                place = place.setdefault(name, {})
            key = tuple(names)
            if names[-1] not in place:
                place[names[-1]] = inner
            elif key in repeated:
                place[names[-1]].append(inner)
            else:
                place[names[-1]] = [place[names[-1]], inner]
                repeated.add(key)
        return out

    def value(self):
        c, began = self.skip(), self.at
        try:
            if c == '"':
                out = _unquoted(self.take(_STRING))
            elif c == "<":
                m = _HEREDOC.match(self.text, self.at)
                self.at = m.end()
                return m.group(2)
            elif c == "[":
                out = self.items("]", self.value)
            elif c == "{":
                out = dict(self.items("}", self.pair))
            else:
                return self.raw()
            self.take(_REST)
            return out
        except (ValueError, AttributeError):
            self.at = began
            return self.raw()

    def items(self, end: str, one) -> list:
        self.at += 1
        out = []
        while (c := self.skip()) != end:
            if not c:
                raise ValueError("a list is not closed")
            out.append(one())
            if self.skip() == ",":
                self.at += 1
        self.at += 1
        return out

    def pair(self):
        name = _unquoted(self.take(_NAME))
        if self.skip() not in ("=", ":"):
            raise ValueError("no value")
        self.at += 1
        return name, self.value()

    def raw(self):
        """An expression's text, up to the line's end outside of brackets."""
        began, closing = self.at, []
        while self.at < len(self.text):
            c = self.text[self.at]
            if c in _OPEN:
                closing.append(_OPEN[c])
            elif closing and c == closing[-1]:
                closing.pop()
            elif not closing and (c in "\n,]})#" or self.text.startswith("//", self.at)):
                break
            elif c == '"':
                self.take(_STRING)
                continue
            elif m := _RAW.match(self.text, self.at):
                self.at = m.end() if closing or "//" not in m.group() else self.at + m.group().index("//")
                continue
            self.at += 1
        said = self.text[began : self.at].strip()
        if not said:
            raise ValueError("no value")
        if said in ("true", "false", "null") or _NUMBER.match(said):
            return json.loads(said)
        return said


def _unquoted(s: str) -> str:
    if not s.startswith('"'):
        return s
    return re.sub(r"\\(.)", lambda m: {"n": "\n", "t": "\t", "r": "\r"}.get(m.group(1), m.group(1)), s[1:-1])


# ---- YAML --------------------------------------------------------------------------------------------------------------

_KEY = re.compile(r"(\"(?:[^\"\\]|\\.)*\"|'(?:[^']|'')*'|[^\s\-?:,\[\]{}#&*!|>'\"%@`][^:#]*?(?::\S[^:#]*?)*|-[^\s:][^:#]*?)\s*:(?:\s+(.*))?$")
_COMMENT = re.compile(r"(?:^|\s)#.*$")
_QUOTED = re.compile(r"(\"(?:[^\"\\]|\\.)*\"|'(?:[^']|'')*')\s*(?:#.*)?$")
_BLOCK = re.compile(r"([|>])([+-]?)\d?([+-]?)\s*(?:#.*)?$")
_FLOAT = re.compile(r"[-+]?(?:\d[\d_]*\.[\d_]*(?:[eE][-+]\d+)?|\.\d+)\Z")
_INT = re.compile(r"[-+]?(?:0|[1-9][\d_]*)\Z")
_WORDS = {**{w: v for k, v in (("true", True), ("yes", True), ("on", True), ("false", False), ("no", False), ("off", False), ("null", None)) for w in (k, k.title(), k.upper())}, "~": None, "": None}


def _scalar(s: str):
    if s[:1] == '"':
        return json.loads(re.sub(r"\\(?![\"\\/bfnrtu])", r"\\\\", s).replace("\t", "\\t"))
    if s[:1] == "'":
        return s[1:-1].replace("''", "'")
    if s in _WORDS:
        return _WORDS[s]
    if s[0] in "&*!%@`":
        raise ValueError("anchors, aliases and tags are not read")
    if _INT.match(s):
        return int(s.replace("_", ""))
    if _FLOAT.match(s):
        return float(s.replace("_", ""))
    return s


_FLOW = re.compile(r"\s*(\"(?:[^\"\\]|\\.)*\"|'(?:[^']|'')*'|[\[\]{},:](?=[\s\[\]{},\"']|$)|[\[\]{},]|[^\s\[\]{},:\"'][^\[\]{},]*?(?=\s*(?:[\[\]{},]|:\s|:$|$)))\s*")


def _flow(text: str):
    """A flow collection from its text."""
    tokens, at = [], 0
    while at < len(text):
        m = _FLOW.match(text, at)
        if not m or m.end() == at:
            raise ValueError("a flow collection is malformed")
        tokens.append(m.group(1))
        at = m.end()
    place = 0

    def one():
        nonlocal place
        t = tokens[place]
        place += 1
        if t not in "[{" or not t:
            return _scalar(t)
        end, out = ("]", []) if t == "[" else ("}", {})
        while tokens[place] != end:
            key = one()
            if end == "}":
                value = None
                if tokens[place] == ":":
                    place += 1
                    value = one() if tokens[place] not in (",", "}") else None
                out[str(key)] = value
            else:
                out.append(key)
            if tokens[place] == ",":
                place += 1
            elif tokens[place] != end:
                raise ValueError("a flow collection is malformed")
        place += 1
        return out

    out = one()
    if place != len(tokens):
        raise ValueError("text after a flow collection")
    return out


class Yaml:
    """A reader of one document's lines, by indentation."""

    def __init__(self, lines: list[str]):
        self.lines, self.at = lines, 0

    def peek(self) -> tuple[int, str]:
        """Indentation and text of the next line that says something; -1 at the end."""
        while self.at < len(self.lines):
            line = self.lines[self.at]
            said = line.strip()
            if said and not said.startswith("#"):
                if "\t" in line[: len(line) - len(line.lstrip())]:
                    raise ValueError("tabs do not indent")
                return len(line) - len(line.lstrip()), said
            self.at += 1
        return -1, ""

    def node(self, least: int):
        indent, said = self.peek()
        if indent < least:
            return None
        if said == "-" or said.startswith("- "):
            return self.sequence(indent)
        if _KEY.match(said):
            return self.mapping(indent)
        self.at += 1
        return self.value(said, indent)

    def sequence(self, indent: int) -> list:
        out = []
        while (p := self.peek())[0] == indent and (p[1] == "-" or p[1].startswith("- ")):
            rest = p[1][1:].lstrip()
            if not rest or rest.startswith("#"):
                self.at += 1
                out.append(self.node(indent + 1))
            elif rest == "-" or rest.startswith("- ") or (_KEY.match(rest) and rest[0] not in "[{"):
                deeper = indent + len(p[1]) - len(rest)
                self.lines[self.at] = " " * deeper + rest
                out.append(self.node(deeper))
            else:
                self.at += 1
                out.append(self.value(rest, indent))
        return out

    def mapping(self, indent: int) -> dict:
        out = {}
        while (p := self.peek())[0] == indent and (m := _KEY.match(p[1])):
            self.at += 1
            key, rest = str(_scalar(m.group(1)) if m.group(1)[0] in "\"'" else m.group(1)), (m.group(2) or "").strip()
            if rest and not rest.startswith("#"):
                out[key] = self.value(rest, indent)
                continue
            below, said = self.peek()
            if below == indent and (said == "-" or said.startswith("- ")):
                out[key] = self.sequence(indent)
            else:
                out[key] = self.node(indent + 1)
        if self.peek()[0] > indent:
            raise ValueError("a line is indented too far")
        return out

    def value(self, said: str, indent: int):
        if said[0] in "[{":
            text = _COMMENT.sub("", said)
            while text.count("[") + text.count("{") > text.count("]") + text.count("}") and self.at < len(self.lines):
                text += " " + _COMMENT.sub("", self.lines[self.at].strip())
                self.at += 1
            return _flow(text)
        if m := _QUOTED.match(said):
            return _scalar(m.group(1))
        if said[0] in "\"'":
            raise ValueError("a quoted scalar is not closed on its line")
        if m := _BLOCK.match(said):
            return self.block(m.group(1), m.group(2) or m.group(3), indent)
        return _scalar(_COMMENT.sub("", said).strip())

    def block(self, style: str, chomp: str, indent: int) -> str:
        taken = []
        while self.at < len(self.lines) and (not self.lines[self.at].strip() or len(self.lines[self.at]) - len(self.lines[self.at].lstrip()) > indent):
            taken.append(self.lines[self.at])
            self.at += 1
        margin = min((len(x) - len(x.lstrip()) for x in taken if x.strip()), default=0)
        text = "\n".join(x[margin:] for x in taken)
        body = text.rstrip("\n")
        if style == ">":
            body = re.sub(r"(?<!\n)\n(?![\n ])", " ", body)
            body = re.sub(r"\n\n", "\n", body)
        return body + {"-": "", "+": text[len(text.rstrip("\n")) :] + "\n"}.get(chomp, "\n" if body else "")


def yaml_documents(text: str) -> list:
    """The documents of a YAML text; raises ValueError where it is not read."""
    docs: list[list[str]] = [[]]
    for line in text.expandtabs(1).split("\n") if "\t" not in text else text.split("\n"):
        if line.startswith("---") and (len(line) == 3 or line[3].isspace()):
            docs.append([line[3:]] if line[3:].strip() and not line[3:].strip().startswith("#") else [])
        elif line.rstrip() == "...":
            docs.append([])
        elif not line.startswith("%"):
            docs[-1].append(line)
    out = []
    for lines in docs:
        reader = Yaml(lines)
        if reader.peek()[0] < 0:
            continue
        out.append(reader.node(0))
        if reader.peek()[0] >= 0:
            raise ValueError("a line is out of place")
    return out


# ---- blocks of messages ------------------------------------------------------------------------------------------------


def documents(language: str, code: str) -> list[dict]:
    """What a fenced block says: JSON in any language, else HCL with resources, or the maps among a YAML text's documents."""
    try:
        got = [json.loads(code)]
    except ValueError:
        try:
            if language in TERRAFORM:
                hcl = Hcl(code).body("")
                got = [hcl] if hcl.get("resource") else []
            else:
                got = yaml_documents(code) if language in KUBERNETES else []
        except (ValueError, RecursionError, IndexError):
            got = []
    return [d for d in got if isinstance(d, dict) and d]


def parsed(language: Column, code: Column) -> Column:
    """The documents of blocks as JSON texts."""

    @F.pandas_udf("array<string>")
    def parse(languages: pd.Series, codes: pd.Series) -> pd.Series:
        said = [[] if b is None else [json.dumps(d) for d in documents(a, b)] for a, b in zip(languages, codes, strict=True)]
        return pd.Series(said, index=codes.index, dtype=object)

    return parse(language, code)


def extracted(messages: DataFrame) -> DataFrame:
    """traj_id, message_index, block, part, kind (terraform, kubernetes or generic) and doc (a variant) of all configurations in messages."""
    found = lambda group: F.regexp_extract_all("content", F.lit(_FENCES), F.lit(group))
    fenced = messages.filter("content IS NOT NULL").select("traj_id", "message_index", F.posexplode(F.arrays_zip(found(1).alias("language"), found(2).alias("code"))).alias("block", "b"))
    blocks = fenced.select("traj_id", "message_index", "block", F.lower("b.language").alias("language"), "b.code")
    docs = blocks.select("traj_id", "message_index", "block", "language", F.posexplode(parsed(F.col("language"), F.col("code"))).alias("part", "json"))
    has = lambda k: F.try_variant_get("doc", f"$.{k}", "variant").isNotNull()
    guess = F.when(has("resource") | has("provider"), "terraform").when(has("apiVersion") | has("kind"), "kubernetes").otherwise("generic")
    kind = F.when(F.col("language").isin(*TERRAFORM), "terraform").when(F.col("language").isin(*KUBERNETES), "kubernetes").otherwise(guess)
    return docs.withColumn("doc", F.parse_json("json")).select("traj_id", "message_index", "block", "part", kind.alias("kind"), "doc")


def configurations(found: DataFrame) -> DataFrame:
    """traj_id, message_index, kind, type, name and config (JSON) of `extracted` documents: a row for each resource, manifest or other document."""
    spark = found.sparkSession
    each = lambda df, v, k, out: df.lateralJoin(spark.tvf.variant_explode(F.col(v).outer()).select(F.col("key").alias(k), F.col("value").alias(out)))
    types = each(found.filter("kind = 'terraform'").withColumn("r", F.try_variant_get("doc", "$.resource", "variant")).filter("r IS NOT NULL"), "r", "type", "of_type")
    named = each(types, "of_type", "name", "body").select("traj_id", "message_index", "kind", "type", "name", F.to_json("body").alias("config"))
    text = lambda path: F.try_variant_get("doc", path, "string")
    manifests = found.filter("kind = 'kubernetes'").select("traj_id", "message_index", "kind", F.coalesce(text("$.kind"), F.lit("")).alias("type"), F.coalesce(text("$.metadata.name"), F.lit("unnamed")).alias("name"), F.to_json("doc").alias("config"))
    rest = found.filter("kind = 'generic'").select("traj_id", "message_index", "kind", F.lit("").alias("type"), F.lit("").alias("name"), F.to_json("doc").alias("config"))
    return named.unionByName(manifests).unionByName(rest)


def resources(texts: DataFrame, text: str = "text") -> DataFrame:
    """traj_id, type, name and config of the resources in plain HCL or JSON texts (traj_id, text)."""
    docs = texts.select("traj_id", F.explode(parsed(F.lit(TERRAFORM[0]), F.col(text))).alias("json"))
    found = docs.select("traj_id", F.lit(0).alias("message_index"), F.lit("terraform").alias("kind"), F.parse_json("json").alias("doc"))
    return configurations(found).select("traj_id", "type", "name", "config")


def message_policy(messages: DataFrame, names: list[str] | None = None, custom: dict | None = None, fail_on_warning: bool = False) -> DataFrame:
    """Verdict rows of the policy rules over the configurations in messages; a trajectory without any has passed."""
    configs = written(configurations(extracted(messages)).drop("message_index"))  # rules read them one by one
    said = S.policy(configs, names, custom, fail_on_warning)
    every = messages.select("traj_id").distinct().join(said, "traj_id", "left")
    return every.select("traj_id", F.lit("policy").alias("plugin"), F.coalesce("status", F.lit("passed")).alias("status"), F.coalesce("message", F.lit("no configuration")).alias("message"), F.coalesce("modifier", F.lit(1.0)).alias("modifier"))


def message_certificates(messages: DataFrame, as_of: Column) -> DataFrame:
    """traj_id, n_violations, status, expires of the configurations in messages: unknown without any, and compliant if there is nothing in them to scan."""
    found = written(extracted(messages).filter("kind <> 'generic'"))
    configs = configurations(found)
    scanned = S.cloud_certificates(configs.filter("kind = 'terraform'"), configs.filter("kind = 'kubernetes'"), as_of)
    some = found.select("traj_id", F.lit(True).alias("some")).distinct()
    out = messages.select("traj_id").distinct().join(some, "traj_id", "left").join(scanned.drop("expires"), "traj_id", "left")
    status = F.when(F.col("some"), F.coalesce("status", F.lit("compliant"))).otherwise("unknown")
    return out.select("traj_id", F.coalesce("n_violations", F.lit(0).cast("bigint")).alias("n_violations"), status.alias("status"), F.when(status == "compliant", as_of + F.expr("INTERVAL 24 HOURS")).alias("expires"))
