"""Result documents and file manifests as tables."""

from __future__ import annotations

import json
import math
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from heldout.functions.checks import EvaluationError, require_columns

LEAVES = 100_000  # rows of a batch that a task hands on
_NUMBER = "^(TINYINT|SMALLINT|INT|BIGINT|FLOAT|DOUBLE|DECIMAL)"


def flatten_json_numeric(docs: DataFrame, *, depth: int | None = None) -> DataFrame:
    """Every numeric leaf of ``(asset, json)`` as ``(asset, json_path, value)``.

    One scan for any nesting: a task walks each document of an Arrow batch with
    a stack of its own.  ``depth`` is the number of levels read, the root being
    the first.  Booleans, strings and nulls are skipped, null text has no leaf;
    malformed text, a repeated key and a number beyond the range of doubles are errors.
    """
    require_columns(docs, ["asset", "json"])
    asset = docs.schema["asset"]

    def run(batches):
        for batch in batches:
            found: tuple[list, list, list] = ([], [], [])
            for name, text in zip(batch.column("asset").to_pylist(), batch.column("json").to_pylist()):
                for path, value in _leaves(text, depth) if text is not None else ():
                    for column, v in zip(found, (name, path, value)):
                        column.append(v)
                    if len(found[0]) == LEAVES:  # a document of many leaves leaves the task in pieces
                        yield _leaf_batch(found, batch.schema.field("asset").type)
                        found = ([], [], [])
            if found[0]:
                yield _leaf_batch(found, batch.schema.field("asset").type)

    schema = T.StructType([asset, T.StructField("json_path", T.StringType()), T.StructField("value", T.DoubleType())])
    return docs.select("asset", "json").mapInArrow(run, schema)


def _leaf_batch(found: tuple[list, list, list], asset: pa.DataType) -> pa.RecordBatch:
    columns = [pa.array(v, t) for v, t in zip(found, (asset, pa.string(), pa.float64()))]
    return pa.RecordBatch.from_arrays(columns, names=["asset", "json_path", "value"])


def _unique(pairs: list[tuple]) -> dict:
    out = dict(pairs)
    if len(out) < len(pairs):
        raise EvaluationError("a JSON object repeats a key")
    return out


def _no_constant(name: str):
    raise EvaluationError(f"{name} is not JSON")


def _leaves(text: str, depth: int | None) -> Iterator[tuple[str, float]]:
    """Paths and values of the numbers of one document, in document order."""
    try:
        root = json.loads(text, object_pairs_hook=_unique, parse_constant=_no_constant)
    except (json.JSONDecodeError, RecursionError) as e:
        raise EvaluationError(f"malformed JSON: {e}") from e
    open_nodes = [("$", root, 1)]
    while open_nodes:
        path, node, level = open_nodes.pop()
        if isinstance(node, (dict, list)):
            if depth is None or level < depth:
                inner = ((f".{k}", v) for k, v in node.items()) if isinstance(node, dict) else ((f"[{i}]", v) for i, v in enumerate(node))
                open_nodes += [(path + step, v, level + 1) for step, v in inner][::-1]
        elif isinstance(node, (int, float)) and not isinstance(node, bool):
            try:
                value = float(node)
            except OverflowError:
                value = math.inf
            if math.isinf(value):
                raise EvaluationError(f"{path} is beyond the range of doubles")
            yield path, value


def _numeric(variant: str) -> str:
    return f"case when schema_of_variant({variant}) rlike '{_NUMBER}' then cast({variant} as double) end"


def _results(docs: DataFrame, member: str, schema: str) -> DataFrame:
    entry = f"array<struct<protocol:string,seed:string,{member}:{schema}>>"
    return docs.selectExpr("asset", f"explode(from_json(json, 'struct<results:{entry}>').results) AS r").selectExpr(
        "asset", "coalesce(r.protocol, '') AS protocol", "r.seed AS seed", f"r.{member} AS member"
    )


def flatten_benchmark_rows(docs: DataFrame) -> DataFrame:
    """``results[].models{model}{context}{target}{metric}`` as long rows."""
    maps = "map<string,map<string,map<string,map<string,variant>>>>"
    long = _results(docs, "models", maps)
    for name in ("model", "context", "target", "metric"):
        keep = [c for c in long.columns if c != "member"]
        long = long.selectExpr(*keep, f"explode(member) AS ({name}, member)")
    return long.selectExpr(
        "asset", "protocol", "seed", "model", "context", "target", "metric", f"{_numeric('member')} AS value"
    ).filter("value is not null")


def flatten_paired_rows(docs: DataFrame) -> DataFrame:
    """``results[].comparisons{}`` scalars and two-element intervals as rows."""
    long = _results(docs, "comparisons", "map<string,map<string,variant>>")
    long = long.selectExpr("asset", "protocol", "explode(member) AS (comparison, member)")
    long = long.selectExpr("asset", "protocol", "comparison", "explode(member) AS (statistic, v)")
    pair = "case when schema_of_variant(v) like 'ARRAY<%' then try_cast(v as array<variant>) end"
    rows = long.selectExpr("asset", "protocol", "comparison", "statistic", "v", f"{pair} AS p").selectExpr(
        "asset", "protocol", "comparison", "statistic",
        f"{_numeric('v')} AS value",
        f"case when size(p) = 2 then {_numeric('p[0]')} end AS ci_low",
        f"case when size(p) = 2 then {_numeric('p[1]')} end AS ci_high",
    )
    return rows.filter("value is not null or (ci_low is not null and ci_high is not null)")


def read_files(spark: SparkSession, root: str, pattern: str = "*") -> DataFrame:
    """Digest and size of each file under ``root``: ``(path, sha256, bytes)``."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", pattern).load(root)
    prefix = root.rstrip("/") + "/"
    return files.select(
        F.substring_index("path", prefix, -1).alias("path"),
        F.sha2("content", 256).alias("sha256"),
        F.col("length").alias("bytes"),
    )


def verify_file_manifest(manifest: DataFrame, files: DataFrame) -> DataFrame:
    """One row per manifest entry or extra file with its ``status``."""
    for df in (manifest, files):
        require_columns(df, ["path", "sha256", "bytes"])
    m = manifest.selectExpr("path", "sha256 AS want_sha", "bytes AS want_bytes", "true AS listed")
    f = files.selectExpr("path", "sha256 AS have_sha", "bytes AS have_bytes", "true AS found")
    return m.join(f, "path", "full_outer").selectExpr(
        "path",
        "case when found is null then 'missing' when listed is null then 'unlisted' "
        "when want_bytes <> have_bytes then 'size_mismatch' when want_sha <> have_sha then 'hash_mismatch' "
        "else 'ok' end AS status",
    )


def check_documents(docs: DataFrame) -> None:
    if docs.filter("try_parse_json(json) is null").head(1):
        raise EvaluationError("a result document is not valid JSON")
