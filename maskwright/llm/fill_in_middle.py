"""Fill-in-middle transformation in DuckDB, batch by batch inside mapInArrow.

Each Arrow batch is registered with an in-memory DuckDB, one SQL statement cuts, draws and joins its texts, and the answer returns as Arrow; no row
passes through Python. The draws come from a SHA-256 of seed and id, so reruns and lost tasks give the same forms. The markers never occur in a
text that is moved, so restored() rebuilds each text from output and form alone.
"""

from __future__ import annotations

from collections.abc import Iterator

import duckdb
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import NULL_ID, keyed, real_id, table

#: A unit: a word with the white space before it, or white space at the end. Units joined are the text.
UNIT = r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+"
#: Prefix, suffix and middle marker.
MARKERS = ("<P>", "<S>", "<M>")
#: UTF-8 bytes of texts in one DuckDB statement, about; a longer text is alone.
BLOCK = 8_000_000
_SCHEMA = "doc_id long, carried %s, n long, form string, prefix_chars long, middle_chars long, output string"


def _quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def transform_sql(source: str, *, seed: int, percent: int, spm_percent: int, markers: tuple[str, str, str], keep: str = "", id_text: str = "CAST(doc_id AS VARCHAR)") -> str:
    """The transformation as DuckDB SQL over a relation (doc_id, text); keep: further columns of it to return, each followed by a comma."""
    p, s, m = map(_quoted, markers)
    eight = lambda k: f"CAST('0x' || substr(h, {8 * k + 1}, 8) AS UBIGINT)"
    return f"""
WITH cut AS (
  SELECT doc_id, {keep} coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '{UNIT}') AS units, sha256('{seed}:' || coalesce({id_text}, '')) AS h FROM {source}
), drawn AS (
  SELECT *, len(units) AS n, {eight(0)} % (len(units) + 1) AS a, {eight(1)} % (len(units) + 1) AS b,
    CASE WHEN text = '' OR contains(text, {p}) OR contains(text, {s}) OR contains(text, {m}) OR {eight(2)} % 100 >= {percent} THEN 'plain' WHEN {eight(3)} % 100 < {spm_percent} THEN 'spm' ELSE 'psm' END AS form
  FROM cut
), parts AS (
  SELECT * EXCLUDE (units), CASE WHEN form <> 'plain' THEN array_to_string(list_slice(units, 1, CAST(least(a, b) AS BIGINT)), '') END AS prefix,
    CASE WHEN form <> 'plain' THEN array_to_string(list_slice(units, CAST(least(a, b) AS BIGINT) + 1, CAST(greatest(a, b) AS BIGINT)), '') END AS middle,
    CASE WHEN form <> 'plain' THEN array_to_string(list_slice(units, CAST(greatest(a, b) AS BIGINT) + 1, n), '') END AS suffix
  FROM drawn
)
SELECT doc_id, {keep} CAST(n AS BIGINT) AS n, form, CAST(length(prefix) AS BIGINT) AS prefix_chars, CAST(length(middle) AS BIGINT) AS middle_chars,
  CASE form WHEN 'psm' THEN {p} || prefix || {s} || suffix || {m} || middle WHEN 'spm' THEN {s} || suffix || {p} || prefix || {m} || middle ELSE text END AS output
FROM parts"""


def _slices(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """Rows in order, as slices of about BLOCK bytes of text."""
    column = batch.column("text")
    sizes = pc.binary_length(column).to_numpy(zero_copy_only=False)
    at, total = 0, 0
    for k, size in enumerate(sizes):
        if total and total + size > BLOCK:
            yield batch.slice(at, k - at)
            at, total = k, 0
        total += int(size)
    if at < batch.num_rows:
        yield batch.slice(at)


def _runner(sql: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with duckdb.connect(config={"threads": 1, "preserve_insertion_order": True, "temp_directory": ""}) as db:
            for batch in batches:
                for some in _slices(batch):
                    # The carried struct stays outside DuckDB; rows keep their order, and their number ties both together.
                    numbers = pa.array(range(some.num_rows), pa.int64())
                    db.register("batch", pa.table({"doc_id": some.column("doc_id"), "text": some.column("text"), "place": numbers}))
                    out = db.sql(f"{sql} ORDER BY place").to_arrow_table().combine_chunks()
                    db.unregister("batch")
                    columns = {name: _plain(out.column(name), kind) for name, kind in (("doc_id", pa.int64()), ("n", pa.int64()), ("form", pa.string()), ("prefix_chars", pa.int64()), ("middle_chars", pa.int64()), ("output", pa.string()))}
                    columns["carried"] = some.column("carried")
                    yield pa.RecordBatch.from_pydict({k: columns[k] for k in ("doc_id", "carried", "n", "form", "prefix_chars", "middle_chars", "output")})

    return run


def _plain(column: pa.ChunkedArray, kind: pa.DataType) -> pa.Array:
    column = column.cast(kind)
    return column.chunk(0) if column.num_chunks == 1 else pa.concat_arrays(column.chunks) if column.num_chunks else pa.array([], kind)


def fill_in_middle(docs: DataFrame, *, seed: int = 42, percent: int = 50, spm_percent: int = 80, markers: tuple[str, str, str] = MARKERS, id_col: str = "doc_id", text_col: str = "text", carry: tuple[str, ...] = ()) -> DataFrame:
    """One row per row of docs: doc_id, carried (a struct of the columns named in carry), n (units), form (plain, psm or spm), prefix_chars, middle_chars (code
    points; null if plain), output.

    percent of the texts change their form, by the hash of seed and id; spm_percent of these begin with the suffix. Empty texts and texts that hold a
    marker stay plain, whatever the draw. A null text is empty, a null id hashes as the empty string; rows that share an id draw alike, each for its own
    text. An empty table gives an empty result. A text of any length is cut whole: a task holds one block of texts, or one longer text, and its units.
    """
    rows = keyed(docs, id_col, text_col, carry)
    sql = transform_sql("batch", seed=seed, percent=percent, spm_percent=spm_percent, markers=markers, keep="place,", id_text=f"CASE WHEN doc_id <> {NULL_ID} THEN CAST(doc_id AS VARCHAR) END")
    out = rows.select("doc_id", "text", "carried").mapInArrow(_runner(sql), _SCHEMA % rows.schema["carried"].dataType.simpleString())
    return out.withColumn("doc_id", real_id())


def restored(output: Column, form: Column, markers: tuple[str, str, str] = MARKERS) -> Column:
    """The text that an output was made of: its parts are found by their markers, each of which the output holds once."""
    first = lambda x, mark: F.substring_index(x, mark, 1)
    rest = lambda x, head, mark: F.substring(x, F.length(head) + 1 + len(mark), F.length(x))
    p, s, m = markers

    def parts(lead: str, second: str) -> tuple[Column, Column, Column]:
        body = F.substring(output, F.lit(len(lead) + 1), F.length(output))
        one = first(body, second)
        tail = rest(body, one, second)
        two = first(tail, m)
        return one, two, rest(tail, two, m)

    prefix, suffix, middle = parts(p, s)
    psm = F.concat(prefix, middle, suffix)
    suffix, prefix, middle = parts(s, p)
    return F.when(form == "psm", psm).when(form == "spm", F.concat(prefix, middle, suffix)).otherwise(output)


def op12_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every row and whole text of documents. Null and empty texts are plain, with the empty text as output; an empty table gives no rows."""
    out = fill_in_middle(table(spark, sf_dir, "documents"))
    digest = lambda x: F.sha2(x.cast("binary"), 256)
    return out.select("doc_id", "n", "form", "prefix_chars", "middle_chars", digest(F.col("output")).alias("output_sha256"), digest(restored(F.col("output"), F.col("form"))).alias("restored_sha256"))


#: Written apart from the operator's own statement: parts by the lengths of units instead of by joining slices; the restored text is the text.
OP12_SQL = rf"""
WITH u AS (
  SELECT doc_id, coalesce(text, '') AS t, list_transform(regexp_extract_all(coalesce(text, ''), '{UNIT}'), lambda x: length(x)) AS sizes, sha256('42:' || doc_id) AS h FROM documents
), c AS (
  SELECT doc_id, t, sizes, len(sizes) AS n, CAST('0x' || h[1:8] AS UBIGINT) % (len(sizes) + 1) AS x, CAST('0x' || h[9:16] AS UBIGINT) % (len(sizes) + 1) AS y,
    t <> '' AND NOT regexp_matches(t, '<[PSM]>') AND CAST('0x' || h[17:24] AS UBIGINT) % 100 < 50 AS moved, CAST('0x' || h[25:32] AS UBIGINT) % 100 < 80 AS suffix_first FROM u
), k AS (
  SELECT *, CAST(coalesce(list_sum(sizes[:least(x, y)]), 0) AS BIGINT) AS a, CAST(coalesce(list_sum(sizes[:greatest(x, y)]), 0) AS BIGINT) AS b FROM c
)
SELECT doc_id, CAST(n AS BIGINT) AS n, CASE WHEN NOT moved THEN 'plain' WHEN suffix_first THEN 'spm' ELSE 'psm' END AS form,
  CASE WHEN moved THEN a END AS prefix_chars, CASE WHEN moved THEN b - a END AS middle_chars,
  sha256(CASE WHEN NOT moved THEN t WHEN suffix_first THEN '<S>' || substr(t, b + 1) || '<P>' || substr(t, 1, a) || '<M>' || substr(t, a + 1, b - a) ELSE '<P>' || substr(t, 1, a) || '<S>' || substr(t, b + 1) || '<M>' || substr(t, a + 1, b - a) END) AS output_sha256,
  sha256(t) AS restored_sha256
FROM k
"""
