"""Declared schemas of the records that cross a file boundary."""

from pyspark.sql import types as T

TRACKS = ("tdd", "bdd")
FAILURE_TYPES = ("none", "assertion", "infrastructure", "timeout")

DATASET_RECORD = T.StructType([
    T.StructField("task_id", T.StringType()),
    T.StructField("entry_point", T.StringType()),
    T.StructField("prompt", T.StringType()),
    T.StructField("canonical_solution", T.StringType()),
])

TASK_METADATA = T.StructType([
    T.StructField("task_id", T.StringType()),
    T.StructField("function_name", T.StringType()),
    T.StructField("track", T.StringType()),
    T.StructField("tdd_source", T.StringType()),
    T.StructField("source", T.StringType()),
])

TASK_DETAIL = T.StructType([
    T.StructField("task_id", T.StringType()),
    T.StructField("mutation_score", T.DoubleType()),
    T.StructField("fault_detection_rate", T.DoubleType()),
    T.StructField("composite_score", T.DoubleType()),
    T.StructField("passed_correct", T.BooleanType()),
    T.StructField("failed_buggy", T.BooleanType()),
])

TASK_REWARDS = T.StructType([
    T.StructField("mutation_score", T.DoubleType()),
    T.StructField("fault_detection_rate", T.DoubleType()),
    T.StructField("track", T.StringType()),
    T.StructField("task_count", T.LongType()),
])

EVAL_RESULT = T.StructType([
    T.StructField("score", T.DoubleType()),
    T.StructField("pass_rate", T.DoubleType()),
    T.StructField("task_rewards", TASK_REWARDS),
    T.StructField("detail", T.StructType([
        T.StructField("task_details", T.ArrayType(TASK_DETAIL)),
    ])),
])

# One document per run. `part` numbers the pieces of a run too long for one document.
RESULT_DOCUMENT = T.StructType([
    T.StructField("participants", T.MapType(T.StringType(), T.StringType())),
    T.StructField("results", T.ArrayType(EVAL_RESULT)),
    T.StructField("trace_id", T.StringType()),
    T.StructField("latency", T.DoubleType()),
    T.StructField("part", T.LongType()),
])

# Boards need the heads of documents only: a parser that is not asked for the details of tasks passes over them.
RESULT_HEAD = T.StructType([
    T.StructField("results", T.ArrayType(T.StructType([g for g in EVAL_RESULT.fields if g.name != "detail"])))
    if f.name == "results" else f for f in RESULT_DOCUMENT.fields])

STORY = T.StructType([
    T.StructField("id", T.StringType()),
    T.StructField("title", T.StringType()),
    T.StructField("description", T.StringType()),
    T.StructField("acceptance", T.ArrayType(T.StringType())),
    T.StructField("files", T.ArrayType(T.StringType())),
    T.StructField("passes", T.BooleanType()),
    T.StructField("completed_at", T.StringType()),
    T.StructField("content_hash", T.StringType()),
    T.StructField("depends_on", T.ArrayType(T.StringType())),
])
