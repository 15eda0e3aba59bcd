"""Column types shared by every operator."""

from __future__ import annotations

from pyspark.sql import types as T

TEXT_TAG = "#text"

# One element or text node.  Document order gives ``id``; the descendants of a
# node are the ids ``id + 1 .. last``.  ``sib`` is the position among the
# parent's element children; ``src_start``/``src_end`` are character positions.
NODE = T.StructType(
    [
        T.StructField("id", T.IntegerType()),
        T.StructField("parent", T.IntegerType()),
        T.StructField("last", T.IntegerType()),
        T.StructField("sib", T.IntegerType()),
        T.StructField("tag", T.StringType()),
        T.StructField("attrs", T.MapType(T.StringType(), T.StringType())),
        T.StructField("text", T.StringType()),
        T.StructField("src_start", T.IntegerType()),
        T.StructField("src_end", T.IntegerType()),
    ]
)
NODES = T.ArrayType(NODE)

PAGES = T.StructType(
    [
        T.StructField("page_id", T.LongType()),
        T.StructField("url", T.StringType()),
        T.StructField("html", T.StringType()),
    ]
)

# The fields of a catalogue record, in their declared order.
ITEM_FIELDS = ["title", "year", "director", "cast", "genre", "synopsis", "poster_url", "streaming_link"]
