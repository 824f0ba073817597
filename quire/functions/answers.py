"""Reading what a model answered: a helper of one answer each, and Arrow-batched functions over them."""

from __future__ import annotations

import json
import re

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType, StructField, StructType

from quire.functions.markup import MarkupError, Node, numeric_references, parse, signature
from quire.functions.text import BARE_AMPERSAND

_BARE = re.compile(BARE_AMPERSAND.encode())
_SEGMENT = StructType([StructField("id", StringType()), StructField("markup", StringType()), StructField("signature", ArrayType(StringType()))])
ANSWER = StructType([StructField("segments", ArrayType(_SEGMENT)), StructField("error", StringType())])


def first_json(text: str, opener: str):
    """The first complete JSON value from the first ``opener`` on; what is around it is ignored."""
    at = text.find(opener)
    if at < 0:
        raise ValueError(f"no {opener} in the answer")
    return json.JSONDecoder().raw_decode(text, at)[0]


def string_list(text: str, length: int) -> list[str]:
    """The first JSON list, if it has this many items and all are strings."""
    found = first_json(text, "[")
    if not isinstance(found, list) or not all(isinstance(x, str) for x in found):
        raise ValueError("the answer is not a list of strings")
    if len(found) != length:
        raise ValueError(f"the answer has {len(found)} items, {length} were asked for")
    return found


def read_segments(text: str) -> list[tuple[str, str, list[str]]]:
    """(id, content, signature) of each ``seg`` element of an answer, in order."""
    a, b = text.find("<seg"), text.rfind("</seg>")
    if a < 0 or b < a:
        raise MarkupError("the answer holds no segment")
    body = _BARE.sub(b"&amp;", numeric_references(text[a : b + 6].encode()))
    document = parse(b"<all>" + body + b"</all>")
    out: list[tuple[str, str, list[str]]] = []
    seen = set()
    for node in document.root.content:
        if not isinstance(node, Node) or node.tag != "seg":
            continue
        name = node.attributes.get("id")
        if name is None:
            raise MarkupError("a segment has no id")
        if name in seen:
            raise MarkupError(f"segment {name} comes more than once")
        seen.add(name)
        out.append((name, document.raw(node.inner, node.close).decode(), sorted(f"{n.attributes.get('n', '')} {n.tag}" for n in node.walk() if n is not node)))
    return out


@F.pandas_udf(ANSWER)
def parse_answer(text: pd.Series) -> pd.DataFrame:
    """The segments of each answer, or why it can't be read."""
    rows = []
    for own in text:
        try:
            rows.append(([{"id": i, "markup": m, "signature": s} for i, m, s in read_segments(own or "")], None))
        except MarkupError as e:
            rows.append((None, str(e)))
    return pd.DataFrame(rows, columns=["segments", "error"])


@F.pandas_udf(ArrayType(StringType()))
def tag_signature(markup: pd.Series) -> pd.Series:
    """The numbered tags of each segment's markup, sorted."""
    return markup.map(signature, na_action="ignore")


@F.pandas_udf(StringType())
def json_value(text: pd.Series, opener: pd.Series) -> pd.Series:
    """The first complete JSON value of each answer, written compactly; null where there is none."""

    def one(own: str | None, mark: str) -> str | None:
        try:
            return json.dumps(first_json(own or "", mark), ensure_ascii=False)
        except ValueError:
            return None

    return pd.Series([one(a, b) for a, b in zip(text, opener, strict=True)], dtype="object")


@F.pandas_udf(StringType())
def yaml_text(value: pd.Series) -> pd.Series:
    """JSON values as YAML, with keys in their order and lines of at most 100 characters where they can be broken."""
    import yaml

    return value.map(lambda x: yaml.safe_dump(json.loads(x), allow_unicode=True, sort_keys=False, width=100), na_action="ignore")


@F.pandas_udf(StructType([StructField("value", StringType()), StructField("error", StringType())]))
def yaml_object(text: pd.Series) -> pd.DataFrame:
    """The mapping that a YAML text holds as JSON, with keys in their order, or why it holds none. An empty text is an empty mapping, null is null."""
    import yaml

    def one(own: str | None) -> tuple[str | None, str | None]:
        if own is None:
            return None, None
        try:
            found = yaml.safe_load(own)
            if not isinstance(found, dict | None):
                return None, "not a mapping"
            return json.dumps(found or {}, ensure_ascii=False, allow_nan=False, default=str), None
        except (yaml.YAMLError, ValueError, TypeError, RecursionError) as e:
            return None, str(e)

    return pd.DataFrame([one(x) for x in text], columns=["value", "error"], dtype="object")
