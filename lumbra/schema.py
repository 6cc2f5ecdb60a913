"""Tables as StructTypes."""

from __future__ import annotations

from pyspark.sql import types as T



def _schema(ddl: str) -> T.StructType:
    fields = []
    for part in ddl.split(","):
        name, kind, *rest = part.split()
        fields.append(T.StructField(name, {"long": T.LongType(), "int": T.IntegerType(), "double": T.DoubleType(), "string": T.StringType(), "vector": T.ArrayType(T.FloatType(), False), "time": T.TimestampType(), "strings": T.ArrayType(T.StringType())}[kind], rest != ["not"]))
    return T.StructType(fields)


QUESTIONS = _schema("id long not, institution string not, year int, raw_text string not, tema_normalized string, subtema_normalized string, embedding vector, source_file string, content_hash string, created_at time")
THEMES = _schema("id long not, tema string not, subtema string, aliases strings, created_at time")
INGEST_LOG = _schema("id long not, file_name string, file_hash string, row_count int, ingested_at time")
METADATA = _schema("key string not, value string")
STATS_ALL = _schema("id long not, institution string not, ranking int, category string not, tema string not, subtema string, percentage double, num_questions int, cor string, cor_hex string, source_file string, created_at time")
STATS = T.StructType([*STATS_ALL.fields, T.StructField("embedding", T.ArrayType(T.FloatType(), False))])
SHEET = _schema("row_idx long not, tema string not, subtema string, equivalencia string, classificacao string, num_questoes string")
CURRICULUM = _schema("position long not, semana string, tema string, subtema string")
VERDICT = T.StructType([T.StructField("index", T.IntegerType()), T.StructField("is_equivalent", T.BooleanType()), T.StructField("confidence", T.DoubleType()), T.StructField("suggested_match", T.StringType()), T.StructField("reasoning", T.StringType())])
REPLY = T.StructType([T.StructField("results", T.ArrayType(VERDICT))])
