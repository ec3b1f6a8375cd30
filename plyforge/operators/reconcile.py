"""Expected against observed: file sets, field bindings, references, claims, closed document schemas."""

from __future__ import annotations

import re
from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# The formats that documents may ask for, as anchored patterns.
SHA256 = r"\A[0-9a-f]{64}\z"
UTC = r"\A[0-9]{4}-[0-9]{2}-[0-9]{2}T[0-9]{2}:[0-9]{2}:[0-9]{2}(?:\.[0-9]+)?Z\z"
IDENTIFIER = r"\A[A-Za-z0-9_-]+\z"


def is_sha256(c: Column) -> Column:
    return F.coalesce(c.rlike(SHA256), F.lit(False))


def is_utc(c: Column) -> Column:
    """ISO 8601 with ``Z``, and a moment that exists."""
    return F.coalesce(c.rlike(UTC) & F.try_to_timestamp(F.substring(c, 1, 19), F.lit("yyyy-MM-dd'T'HH:mm:ss")).isNotNull(), F.lit(False))


def is_identifier(c: Column) -> Column:
    return F.coalesce(c.rlike(IDENTIFIER), F.lit(False))


def is_label(c: Column) -> Column:
    """Not blank and without control characters."""
    return F.coalesce((F.trim(c) != "") & ~c.rlike(r"[\u0000-\u001f\u007f]"), F.lit(False))


def is_neutral_path(c: Column) -> Column:
    """Relative, with forward slashes, no empty, ``.`` or ``..`` part, drive or control character."""
    parts = F.split(c, "/")
    odd = F.exists(parts, lambda p: p.isin("", ".", ".."))
    return F.coalesce(~c.rlike(r"[\u0000-\u001f\u007f\\]") & ~c.rlike(r"\A[A-Za-z]:") & ~odd, F.lit(False))


def file_diff(expected: DataFrame, actual: DataFrame) -> DataFrame:
    """(``path``, ``status``, ``expected_sha256``, ``actual_sha256``) of every path that isn't alike on both sides.

    ``missing``, ``extra``, ``sha256`` or ``size``, the first that fits. Inputs:
    (``path``, ``sha256``, ``size_bytes``), paths unique on each side.
    """
    e = expected.select("path", F.struct("sha256", "size_bytes").alias("e"))
    a = actual.select("path", F.struct("sha256", "size_bytes").alias("a"))
    j = e.join(a, "path", "full")
    size = F.col("e.size_bytes").isNotNull() & F.col("a.size_bytes").isNotNull() & (F.col("e.size_bytes") != F.col("a.size_bytes"))
    status = F.when(F.col("a").isNull(), "missing").when(F.col("e").isNull(), "extra").when(
        ~F.col("e.sha256").eqNullSafe(F.col("a.sha256")), "sha256"
    ).when(size, "size")
    return j.select(
        "path", status.alias("status"), F.col("e.sha256").alias("expected_sha256"), F.col("a.sha256").alias("actual_sha256")
    ).filter("status is not null")


def transport_problems(listed: DataFrame, present: DataFrame, required: DataFrame) -> DataFrame:
    """(``problem``, ``path``): a checksum list against a payload and the files that must be there.

    Bytes are compared only where the set of files is as it should be.
    """
    tag = lambda df, name: df.select(F.lit(name).alias("problem"), "path")
    missing = tag(listed.join(present, "path", "left_anti"), "listed_but_absent")
    extra = tag(present.join(listed, "path", "left_anti"), "present_but_unlisted")
    needed = tag(required.join(listed, "path", "left_anti"), "required_but_unlisted")
    structure = missing.unionByName(extra).unionByName(needed)
    differs = listed.alias("l").join(present.alias("p"), "path").filter(~F.col("l.sha256").eqNullSafe(F.col("p.sha256"))).select(
        F.lit("sha256_mismatch").alias("problem"), "path"
    )
    return structure if structure.limit(1).count() else differs


def field_mismatches(expected: DataFrame, actual: DataFrame, key: str, bindings: Mapping[str, str]) -> DataFrame:
    """One row per key of both sides: ``verified`` and ``mismatched`` field names, in the order of ``bindings`` (expected to actual column).

    Maps and variants compare by content through their sorted entries; nulls equal nulls.
    """
    kinds = {n: t for n, t in [*expected.dtypes]}
    plain = lambda side, c: F.array_sort(F.map_entries(F.col(f"{side}.{c}"))) if kinds.get(c, "").startswith("map") else F.col(f"{side}.{c}")
    j = expected.alias("e").join(actual.alias("a"), key)
    same = {
        e: plain("e", e).eqNullSafe(F.array_sort(F.map_entries(F.col(f"a.{a}"))) if kinds.get(e, "").startswith("map") else F.col(f"a.{a}")) for e,
        a in bindings.items()
    }
    pick = lambda flip: F.array_compact(F.array(*[F.when(~s if flip else s, F.lit(f)) for f, s in same.items()]))
    return j.select(F.col(f"e.{key}").alias(key), pick(False).alias("verified"), pick(True).alias("mismatched"))


def key_set_problems(doc_keys: Column, wanted: list[str]) -> Column:
    """struct(missing, unexpected) of a document's keys, sorted."""
    want = F.array(*[F.lit(k) for k in wanted])
    return F.struct(F.array_sort(F.array_except(want, doc_keys)).alias("missing"), F.array_sort(F.array_except(doc_keys, want)).alias("unexpected"))


def unresolved(references: DataFrame, files: DataFrame, ref: str, path: str = "path") -> DataFrame:
    """References that name no file of the set; null references refer to nothing and are fine."""
    return references.filter(F.col(ref).isNotNull()).join(files.select(F.col(path).alias(ref)), ref, "left_anti")


def bound_claims(evidence: DataFrame, artifacts: DataFrame, claims: DataFrame, withheld: str | None = None, needs: str | None = None) -> DataFrame:
    """(``artifact_sha256``, ``claims`` sorted): what evidence bound to each artifact establishes.

    Evidence is bound when its ``subject_sha256`` is the artifact's and
    corroborates when its ``result`` is the ``expected`` one. ``claims`` maps
    evidence ``kind`` to ``claim``. The claim ``withheld`` counts only beside
    the claim ``needs``.
    """
    good = evidence.filter(F.col("result").eqNullSafe(F.col("expected")))
    found = artifacts.select(F.col("sha256").alias("artifact_sha256")).distinct().join(
        good.withColumnRenamed("subject_sha256", "artifact_sha256"), "artifact_sha256", "left"
    ).join(claims, "kind", "left")
    out = found.groupBy("artifact_sha256").agg(F.array_sort(F.collect_set("claim")).alias("claims"))
    if withheld and needs:
        bare = F.array_remove("claims", withheld)
        out = out.withColumn("claims", F.when(F.array_contains("claims", needs), F.col("claims")).otherwise(bare))
    return out


def shared_values(df: DataFrame, by: list[str], member: str, column: str) -> DataFrame:
    """Per group the number of distinct values of a column that all members should share, and who holds which (nulls count as a value)."""
    v = F.coalesce(F.col(column).cast("string"), F.lit("")).alias("value")
    per = df.groupBy(*by, v).agg(F.array_sort(F.collect_set(member)).alias("members"))
    return per.groupBy(*by).agg(
        F.count(F.lit(1)).alias("distinct_values"), F.array_sort(F.collect_list(F.struct("value", "members"))).alias("holders")
    )


def role_counts(df: DataFrame, by: list[str], role: str, exactly_one: str, at_least_one: str) -> DataFrame:
    """Per group the counts of both roles and whether they are as they must be."""
    one, many = F.count_if(F.col(role) == exactly_one), F.count_if(F.col(role) == at_least_one)
    return df.groupBy(*by).agg(one.alias("ones"), many.alias("others")).withColumn("sound", (F.col("ones") == 1) & (F.col("others") >= 1))


def checksum_lines(files: DataFrame, content: str = "content", path: str = "path") -> DataFrame:
    """(``file``, ``line_no``, ``sha256``, ``listed_path``, ``problem``) of every line of checksum lists.

    A line is 64 lower-case hex digits, two blanks, a neutral path that isn't
    the list's own name, was not listed before and sorts after the path before.
    """
    own = F.element_at(F.split(F.col(path), "/"), -1)
    text = F.regexp_replace(F.col(content).cast("string"), r"\n\z", "")
    lines = files.select(F.col(path).alias("file"), own.alias("own"), F.posexplode(F.split(text, "\n")).alias("k", "line"))
    grammar = r"\A([0-9a-f]{64})  (.+)\z"
    fits = F.col("line").rlike(grammar)
    lines = lines.select(
        "file", "own", (F.col("k") + 1).alias("line_no"), F.when(fits, F.regexp_extract("line", grammar, 1)).alias("sha256"),
        F.when(fits, F.regexp_extract("line", grammar, 2)).alias("listed_path")
    )
    w = Window.partitionBy("file").orderBy("line_no")
    same = Window.partitionBy("file", "listed_path").orderBy("line_no")
    p = F.col("listed_path")
    lines = lines.withColumns({"__n": F.row_number().over(same), "__before": F.max("listed_path").over(w.rowsBetween(Window.unboundedPreceding, -1))})
    problem = F.when(p.isNull(), "grammar").when(~is_neutral_path(p), "path").when(p == F.col("own"), "own_name").when(F.col("__n") > 1, "duplicate").when(p < F.col("__before"), "order")
    return lines.select("file", "line_no", "sha256", "listed_path", problem.alias("problem"))


def checksum_text(files: DataFrame, by: list[str]) -> DataFrame:
    """Per group the text of a checksum list: ``sha256``, two blanks, path, line feed, sorted by path."""
    entries = F.array_sort(F.collect_list(F.struct("path", "sha256")))
    lines = F.transform(entries, lambda e: F.concat(e["sha256"], F.lit("  "), e["path"], F.lit("\n")))
    return files.groupBy(*by).agg(F.array_join(lines, "").alias("text"))


def schema_violations(docs: DataFrame, key: str, text: str, schema: Mapping) -> DataFrame:
    """(key, ``path``, ``rule``) of everything by which JSON documents break a closed schema.

    The schema's rules (type, enum, required, additionalProperties, items,
    minLength, pattern, format, minimum) are compiled once into one column
    expression over a VARIANT, so all errors of all documents come from one scan
    without Python. Types are those of the text: ``1`` is an integer and a
    number, ``1.0`` a number only, booleans neither. Rules below a wrong type
    aren't looked at. Text that is no JSON gives rule ``json``.
    """
    parsed = docs.select(key, F.try_parse_json(text).alias("v"))
    found = [_broken_rules(parsed, [key], schema, F.lit("$"))]
    # one further scan for each array of objects: its elements are rows of their own
    for name, sub in schema.get("properties", {}).items():
        if "items" in sub:
            items = parsed.select(key, F.posexplode(F.try_variant_get("v", f"$.{name}", "array<variant>")).alias("__i", "v"))
            found.append(
                _broken_rules(items, [key, "__i"], sub["items"], F.concat(F.lit(f"$.{name}["), F.col("__i").cast("string"), F.lit("]"))).drop("__i")
            )
    out = found[0]
    for f in found[1:]:
        out = out.unionByName(f)
    return out


def _of_type(kind: Column, names: list[str]) -> Column:
    tests = {
        "object": kind.startswith("OBJECT"), "array": kind.startswith("ARRAY"), "string": kind == "STRING", "boolean": kind == "BOOLEAN",
        "integer": kind == "BIGINT", "number": kind.isin("BIGINT", "DOUBLE") | kind.startswith("DECIMAL"), "null": kind == "VOID"
    }
    out = F.lit(False)
    for n in names:
        out = out | tests[n]
    return out


def _broken_rules(df: DataFrame, keys: list[str], schema: Mapping, root: Column) -> DataFrame:
    """(keys, path, rule) of every rule that the variant ``v`` breaks; null gives rule ``json``.

    Nodes of one depth become columns of one projection (value, kind, keys), so
    nothing is looked up twice.
    """
    rules: list[Column] = []
    level = [("v", schema, "")]
    df = df.withColumn("__ok_v", F.col("v").isNotNull())
    depth = 0
    while level:
        kinds = {f"__kind_{c}": F.schema_of_variant(F.col(c)) for c, *_ in level}
        df = df.withColumns(kinds)
        df = df.withColumns(
            {
                f"__keys_{c}": F.when(F.col(f"__kind_{c}").startswith("OBJECT"), F.json_object_keys(F.to_json(F.col(c)))) for c, s,
                _ in level if "properties" in s
            } | {f"__text_{c}": F.when(F.col(f"__kind_{c}") == "STRING", F.col(c).cast("string")) for c, *_ in level}
        )
        values, present, below = {}, {}, []
        for c, s, path in level:
            v, kind, text, here = F.col(c), F.col(f"__kind_{c}"), F.col(f"__text_{c}"), F.col(f"__ok_{c}")
            hit = lambda when, rule, at=path: rules.append(
                F.when(when, F.struct(F.concat(root, F.lit(at)).alias("path"), F.lit(rule).alias("rule")))
            )
            right = here
            if "type" in s:
                fits = _of_type(kind, s["type"] if isinstance(s["type"], list) else [s["type"]])
                hit(here & ~fits, "type")
                right = here & fits
            if "enum" in s:
                hit(right & ~F.coalesce(v.cast("string").isin(*[str(x) for x in s["enum"]]), F.lit(False)), "enum")
            if "minLength" in s:
                hit(right & (F.length(text) < s["minLength"]), "minLength")
            if "pattern" in s:
                hit(right & ~text.rlike(r"\A(?:" + re.sub(r"\A\^|\$\Z", "", s["pattern"]) + r")\z"), "pattern")
            if "format" in s:
                test = {"sha256-hex": is_sha256, "utc-iso8601": is_utc, "relative-neutral-path": is_neutral_path}.get(s["format"])
                hit(right & text.isNotNull() & (~test(text) if test else F.lit(True)), "format")
            if "minimum" in s:
                hit(right & (F.when(_of_type(kind, ["number"]), v.cast("double")) < s["minimum"]), "minimum")
            if "properties" in s:
                held = F.col(f"__keys_{c}")
                is_object = right & held.isNotNull()
                for k in s.get("required", []):
                    hit(is_object & ~F.array_contains(held, k), "required", f"{path}.{k}")
                if s.get("additionalProperties", True) is False:
                    hit(is_object & (F.size(F.array_except(held, F.array(*[F.lit(k) for k in s["properties"]]))) > 0), "additionalProperties")
                for k, sub in s["properties"].items():
                    name = f"__v{depth}_{len(below)}"
                    values[name] = F.try_variant_get(v, f"$.{k}", "variant")
                    present[f"__ok_{name}"] = is_object & F.array_contains(held, k)
                    below.append((name, sub, f"{path}.{k}"))
        df = df.withColumns(values | present) if values else df
        level, depth = below, depth + 1
    broken = F.array(F.struct(F.concat(root, F.lit("")).alias("path"), F.lit("json").alias("rule")))
    return df.select(
        *keys, F.explode(F.when(F.col("v").isNull(), broken).otherwise(F.array_compact(F.array(*rules)))).alias("e")
    ).select(*keys, "e.path", "e.rule")
