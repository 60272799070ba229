"""What the tests of the training-data operators share."""

import os

from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

DOCUMENTS = StructType([
    StructField("doc_id", LongType()), StructField("text", StringType()), StructField("lang", StringType()),
    StructField("source", StringType()), StructField("n_chars", LongType()),
])
FOLDER = os.environ.get("SF_DIR", "/root/testdata/sf0.001")


def clashing(frame, *names):
    """The frame with columns named like the operators' own."""
    for name in names:
        frame = frame.withColumn(name, F.lit(1))
    return frame
