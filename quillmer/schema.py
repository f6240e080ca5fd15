"""Schemas of the engine's tables."""

from pyspark.sql import types as T

MANIFEST = T.StructType([T.StructField("sample_id", T.IntegerType()), T.StructField("grp", T.StringType()), T.StructField("path", T.StringType()), T.StructField("db", T.StringType())])
READS = T.StructType([T.StructField("sample_id", T.IntegerType()), T.StructField("read_no", T.LongType()), T.StructField("name", T.StringType()), T.StructField("seq", T.StringType()), T.StructField("qual", T.StringType())])
COUNTS = T.StructType([T.StructField("sample_id", T.IntegerType()), T.StructField("kmer", T.LongType()), T.StructField("cnt", T.LongType())])
FEATURES = T.StructType([T.StructField("feature_id", T.LongType()), T.StructField("kmer", T.LongType())])
CLUSTERS = T.StructType([T.StructField("cluster_id", T.LongType()), T.StructField("values", T.ArrayType(T.DoubleType())), T.StructField("n", T.LongType())])
MEMBERS = T.StructType([T.StructField("cluster_id", T.LongType()), T.StructField("feature_id", T.LongType())])
