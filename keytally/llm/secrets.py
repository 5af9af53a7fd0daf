"""Secrets in texts, with credentials of several parts linked.

Plain finds are assignments to secret-like names, access key ids and long hex
strings. Weaker candidates are common and mostly harmless by themselves:
identifiers (account names, client ids), random-looking strings, and endpoints.
They are reported only if their complementary parts stand within ``SCOPE`` code
points in the same text, found by an interval join:

* an identifier with a secret (an assignment, a hex string or a random-looking string),
* a random-looking string with an identifier or an access key id,
* an endpoint with both.
"""

from __future__ import annotations

import re
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from keytally.llm.tables import stored, text_or_empty

#: Code points between two parts of one credential, at most.
SCOPE = 200
BATCH_ROWS = 2_000

# The plain finds. Their order is the order of kinds at one start.
BASE_KINDS = ("assign", "access", "hex")
ASSIGN = r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]+"
HEX = r"[0-9a-f]+"
ASSIGN_LEAST, ACCESS_LEAST, HEX_LEAST = 6, 20, 24

#: Kinds the linking adds, after the plain ones.
LINKED_KINDS = ("identifier", "random", "endpoint")
IDENTIFIER = r"""\b(user(?:_?name)?|login|account(?:_?id)?|client_?id|access_?key(?:_?id)?)["']?\x20*[:=]\x20*["']?([A-Za-z0-9@._-]{3,})"""
RANDOM = r"[A-Za-z0-9+/_-]{16,}={0,2}"
ENDPOINT = r"[A-Za-z][A-Za-z0-9+.-]*://[^\s\"'<>]{3,}"
_KINDS = BASE_KINDS + LINKED_KINDS


class Found(NamedTuple):
    kind: int
    start: int
    end: int


class _Finder:
    """Compiled patterns, and cheap ones that tell which texts of a batch can match at all."""

    def __init__(self) -> None:
        # ASCII keeps letters such as the long s from matching in either case.
        self.assign = re.compile(ASSIGN, re.IGNORECASE | re.ASCII)
        self.access = re.compile(ACCESS)
        self.hex = re.compile(rf"[0-9a-f]{{{HEX_LEAST},}}")
        self.identifier = re.compile(IDENTIFIER, re.IGNORECASE | re.ASCII)
        self.random = re.compile(RANDOM)
        self.endpoint = re.compile(ENDPOINT)
        self.may = {
            "assign": r"(?i)(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]",
            "access": r"AKIA[A-Z0-9]{16}",
            "hex": rf"[0-9a-f]{{{HEX_LEAST}}}",
            "identifier": r"(?i)(user|login|account|client_?id|access_?key)[a-z_]*[\"']?\x20*[:=]",
            "endpoint": r"[A-Za-z]://",
        }

    def base(self, text: str, can: set[str]) -> list[Found]:
        found = []
        if "assign" in can:
            for m in self.assign.finditer(text):
                if m.end(2) - m.start(2) >= ASSIGN_LEAST:
                    found.append(Found(0, m.start(), m.end()))
        if "access" in can:
            found += [Found(1, *m.span()) for m in self.access.finditer(text) if m.end() - m.start() >= ACCESS_LEAST]
        if "hex" in can:
            found += [Found(2, *m.span()) for m in self.hex.finditer(text)]
        return found

    def weak(self, text: str, can: set[str], base: list[Found]) -> list[Found]:
        """Candidates in a text that has someone to identify; a random string in a plain find is not a new one."""
        if "identifier" not in can and not any(f.kind == 1 for f in base):
            return []
        found = [Found(3, *m.span()) for m in self.identifier.finditer(text)] if "identifier" in can else []
        if "endpoint" in can:
            found += [Found(5, *m.span()) for m in self.endpoint.finditer(text)]
        taken = sorted((f.start, f.end) for f in base + found)
        starts, ends = (np.array([pair[k] for pair in taken], np.int64) for k in (0, 1))
        for m in self.random.finditer(text):
            at = int(np.searchsorted(starts, m.end()))
            if at and ends[:at].max() > m.start():
                continue
            token = m.group()
            digits = sum(c.isdigit() for c in token)
            if digits >= 3 and len(token) - digits >= 3 and len(set(token)) >= 10:
                found.append(Found(4, *m.span()))
        return found


def _scan(text: Column) -> Column:
    """Plain finds and candidates of each text, as lists of ``(kind, start, end)``."""
    part = "array<struct<kind: int, start: int, end: int>>"

    @F.arrow_udf(f"struct<base: {part}, weak: {part}>")
    def of(texts: pa.Array) -> pa.Array:
        finder = _Finder()
        can: dict[int, set[str]] = {}
        for name, pattern in finder.may.items():
            for i in np.flatnonzero(pc.match_substring_regex(texts, pattern).to_numpy(zero_copy_only=False)):
                can.setdefault(int(i), set()).add(name)
        base: list[list] = [[] for _ in range(len(texts))]
        weak: list[list] = [[] for _ in range(len(texts))]
        for i, names in can.items():
            said = texts[i].as_py()
            plain = finder.base(said, names)
            base[i] = [f._asdict() for f in plain]
            weak[i] = [f._asdict() for f in finder.weak(said, names, plain)]
        kind = pa.list_(pa.struct([("kind", pa.int32()), ("start", pa.int32()), ("end", pa.int32())]))
        return pa.StructArray.from_arrays([pa.array(base, kind), pa.array(weak, kind)], ["base", "weak"])

    return of.asNondeterministic()(text)


def linked_parts(scans: DataFrame, scope: int = SCOPE) -> DataFrame:
    """``(row, linked)``: the candidates of each row that have their complementary parts near by.

    Parts are put into bins of ``scope`` code points and joined with the same
    bin and the two beside it, so the pairs of a text grow with its parts, not
    with their square: a bin has room for few of them.
    """
    parts = scans.filter(F.size("weak") > 0).select("row", F.explode(F.concat("base", "weak")).alias("p")).select("row", "p.*")
    role = F.when(F.col("kind").isin(1, 3), "who").when(F.col("kind") == 5, "where").otherwise("secret")
    parts = parts.withColumns({"role": role, "bin": F.floor(F.col("start") / scope)})
    near = parts.filter("role <> 'where'").select(
        "row",
        F.col("role").alias("other"),
        F.col("start").alias("from"),
        F.col("end").alias("to"),
        # A long part reaches over several bins; every bin it is near to sees it.
        F.explode(F.sequence(F.floor(F.col("start") / scope) - 1, F.floor(F.col("end") / scope) + 1)).alias("bin"),
    )
    weak = parts.filter("kind >= 3")
    weak = weak.withColumn("bin", F.explode(F.sequence(F.floor(F.col("start") / scope), F.floor(F.col("end") / scope))))
    met = weak.join(near, ["row", "bin"]).filter(F.col("role") != F.col("other"))
    met = met.filter((F.col("from") <= F.col("end") + scope) & (F.col("start") <= F.col("to") + scope))
    roles = met.groupBy("row", "kind", "start", "end").agg(
        F.max(F.col("other") == "who").alias("who"), F.max(F.col("other") == "secret").alias("secret")
    )
    whole = (
        ((F.col("kind") == 3) & F.col("secret"))
        | ((F.col("kind") == 4) & F.col("who"))
        | ((F.col("kind") == 5) & F.col("who") & F.col("secret"))
    )
    return roles.filter(whole).groupBy("row").agg(F.collect_list(F.struct("kind", "start", "end")).alias("linked"))


def _listed(spans: str) -> Column:
    names = F.array(*[F.lit(k) for k in _KINDS])
    order = F.array_sort(F.transform(spans, lambda s: F.struct(s["start"].alias("start"), s["kind"].alias("kind"), s["end"].alias("end"))))
    text = F.transform(order, lambda s: F.concat_ws(":", F.element_at(names, s["kind"] + 1), s["start"].cast("string"), s["end"].cast("string")))
    return F.array_join(text, ",")


def find_secrets(docs: DataFrame, id: str = "doc_id", text: str = "text", scope: int = SCOPE) -> DataFrame:
    """``(doc_id, base, linked)`` per row of ``docs``: lists of ``(kind, start, end)`` in code points, the end excluded.

    ``kind`` counts from 0 in the order of ``BASE_KINDS`` and ``LINKED_KINDS``.
    Plain finds of a kind are leftmost and do not overlap; those of different
    kinds may. NULL texts are empty and have none; rows that repeat an id, or
    have none, each have their own result. Other columns are not read.
    """
    scans = docs.select(
        F.monotonically_increasing_id().alias("row"), F.col(id).alias("doc_id"), _scan(text_or_empty(text)).alias("s")
    )
    scans = stored(scans.select("row", "doc_id", "s.*"), "parts", BATCH_ROWS)
    linked = linked_parts(scans, scope)
    none = F.array().cast("array<struct<kind: int, start: int, end: int>>")
    return scans.join(linked, "row", "left").select("doc_id", "base", F.coalesce("linked", none).alias("linked"))


def secrets_digest(docs: DataFrame) -> DataFrame:
    """One row per document with counts and span lists as text."""
    found = find_secrets(docs)

    def count(kind: int) -> Column:
        return F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("bigint")

    return found.select(
        "doc_id",
        *[count(k).alias(f"n_{name}") for k, name in enumerate(BASE_KINDS)],
        F.sha2(_listed("base").cast("binary"), 256).alias("base_sha256"),
        _listed(F.concat("base", "linked")).alias("spans"),
        F.size("linked").cast("bigint").alias("n_linked"),
    )
