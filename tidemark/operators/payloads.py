"""JSON request and response payloads to typed rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

PREDICTIONS = "predictions"

# Fixed names of the payload keys; the first one present decides the shape.
_SHAPES = """
    dataframe_records array<variant>,
    columns array<string>,
    data array<array<variant>>,
    instances array<variant>,
    inputs map<string, array<variant>>,
    predictions array<variant>
"""


def _object(names: Column, values: Column) -> Column:
    """JSON object text of parallel arrays of names and values; the shorter one ends it."""
    fields = F.transform(
        F.arrays_zip(names.alias("k"), values.alias("v")),
        lambda kv: F.when(
            kv["k"].isNotNull(),
            F.concat(
                _quoted(kv["k"]),
                F.lit(":"),
                F.coalesce(F.to_json(kv["v"]), F.lit("null")),
            ),
        ),
    )
    size = F.least(F.size(names), F.size(values))
    return F.concat(F.lit("{"), F.array_join(F.slice(fields, 1, size), ","), F.lit("}"))


def _quoted(text: Column) -> Column:
    """A JSON string literal."""
    array = F.to_json(F.array(text))
    return F.substring(array, F.lit(2), F.length(array) - 2)


def record_array(payload: Column, prediction_col: str = PREDICTIONS) -> Column:
    """Payload text of any accepted shape as the text of a JSON record array.

    Another object gives an empty array; text that is no JSON object stays as it is.  Of a
    repeated key the last value counts.
    """
    p = F.from_json(payload, _SHAPES)
    split = F.transform(p["data"], lambda row: _object(p["columns"], row))
    names, lists = F.map_keys(p["inputs"]), F.map_values(p["inputs"])
    shortest = F.coalesce(F.array_min(F.transform(lists, F.size)), F.lit(0))
    columnar = F.when(
        shortest > 0,
        F.transform(
            F.sequence(F.lit(0), F.greatest(shortest - 1, F.lit(0))),
            lambda i: _object(names, F.transform(lists, lambda xs: F.get(xs, i))),
        ),
    ).otherwise(F.array().cast("array<string>"))
    predictions = F.transform(
        p["predictions"],
        lambda v: F.concat(
            F.lit("{"), _quoted(F.lit(prediction_col)), F.lit(":"), F.coalesce(F.to_json(v), F.lit("null")), F.lit("}")
        ),
    )

    def as_text(values: Column) -> Column:
        return F.transform(values, lambda v: F.coalesce(F.to_json(v), F.lit("null")))

    records = F.coalesce(
        as_text(p["dataframe_records"]),
        F.when(p["columns"].isNotNull(), split),
        as_text(p["instances"]),
        F.when(p["inputs"].isNotNull(), columnar),
        predictions,
        F.array().cast("array<string>"),
    )
    # Keys of the outermost object; of anything else there are none.
    is_object = F.json_object_keys(payload).isNotNull()
    return F.when(is_object, F.concat(F.lit("["), F.array_join(records, ","), F.lit("]"))).otherwise(
        payload
    )


def typed_records(payload: Column, fields: T.StructType, prediction_col: str = PREDICTIONS) -> Column:
    """Payload to ``array<struct>``; NULL when it cannot be read so."""
    return F.from_json(record_array(payload, prediction_col), T.ArrayType(fields))


def explode_batches(df: DataFrame, request: str = "request", response: str = "response") -> DataFrame:
    """One row per record: requests and responses are paired by position.

    The shorter side is padded with NULLs; ``_position`` counts from 0.
    """
    zipped = F.arrays_zip(F.col(request).alias("q"), F.col(response).alias("a"))
    paired = df.select("*", F.posexplode(zipped).alias("_position", "_pair"))
    rest = [c for c in df.columns if c not in (request, response)]
    return paired.select(*[f"`{c}`" for c in rest], "_position", "_pair.q.*", "_pair.a.*")


def process_requests(
    raw: DataFrame,
    request_fields: T.StructType,
    response_field: T.StructField,
    id_cols: list[str],
    timestamp_col: str = "timestamp",
    example_id_col: str = "example_id",
) -> DataFrame:
    """Raw request log to typed rows, in batch and in streams alike.

    The example id is the hash of the log row's id and the position in its batch, so
    processing a log row again gives the same ids.
    """
    response = T.StructType([response_field])
    unpacked = raw.withColumns(
        {
            "request": typed_records(F.col("request"), request_fields, response_field.name),
            "response": typed_records(F.col("response"), response, response_field.name),
        }
    )
    rows = explode_batches(unpacked)
    parts = [F.col(f"`{c}`").cast("string") for c in id_cols]
    return rows.withColumns(
        {
            timestamp_col: F.timestamp_millis(F.col("timestamp_ms")),
            example_id_col: F.md5(F.concat_ws("-", *parts, F.col("_position").cast("string"))),
        }
    ).drop("timestamp_ms", "_position")
