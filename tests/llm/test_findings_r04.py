"""Steps of the findings of round 4 whose memory grew with the blocks of a task."""

from urllib.parse import urlparse

import pyarrow.dataset as ds

from tidemark.llm import collocations


def groups_and_rows(table):
    files = ds.dataset(urlparse(table._table_path).path, format="parquet").get_fragments()
    return [(f.metadata.num_row_groups, f.metadata.num_rows) for f in files if f.metadata.num_rows]


def test_blocks_of_occurrences_are_row_groups_of_their_own(spark):
    """A writer holds a row group, and a reader decodes one at once; all blocks of a task were one."""
    docs = spark.createDataFrame([("one two three one two", g) for g in ("de", "en", "es", "fr")], "text string, lang string").coalesce(1)
    relation = collocations.words(docs, "text", "lang")
    assert groups_and_rows(relation) == [(4, 4)]
    longer = collocations.extended(relation.coalesce(1), ["group", "word"], collocations.frequent(relation, ["group", "word"], 2))
    assert all(groups == rows for groups, rows in groups_and_rows(longer)) and longer.count() == 4
