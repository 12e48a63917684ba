"""Table schemas of the data model."""

from pyspark.sql.types import (ArrayType, FloatType, LongType, StringType,
                               StructField, StructType)

# The post record: eleven nullable strings, never inferred.
POST_COLUMNS = [
    "url", "site", "document", "documenttype", "postdate", "likes",
    "dislike", "comment_cnt", "views", "boardcategory", "documentcategory",
]
POST_SCHEMA = StructType([StructField(c, StringType(), True) for c in POST_COLUMNS])

# Run partition columns (user, keyword, run id formatted yyyy-MM-ddTHHhMMmSSs).
RUN_KEYS = ["user_id", "keyword", "run_id"]
STORE_KEYS = ["user_id", "keyword"]

# Vector store rows: the post columns as metadata, the content, the vector.
STORE_SCHEMA = StructType(
    [StructField("doc_id", LongType(), True)]
    + [StructField(c, StringType(), True) for c in POST_COLUMNS]
    + [StructField("embedding", ArrayType(FloatType()), True),
       StructField("user_id", StringType(), True),
       StructField("keyword", StringType(), True)]
)

HISTORY_SCHEMA = StructType([
    StructField("conv_id", LongType(), True),
    StructField("turn", LongType(), True),
    StructField("role", StringType(), True),
    StructField("text", StringType(), True),
    StructField("user_id", StringType(), True),
    StructField("keyword", StringType(), True),
])

# Run tables: the post record and its run.
RUN_SCHEMA = StructType(list(POST_SCHEMA.fields) + [StructField(c, StringType(), True) for c in RUN_KEYS])
