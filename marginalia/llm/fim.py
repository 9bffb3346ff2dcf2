"""Fill-in-middle transformation by DuckDB inside `mapInArrow`.

Each Arrow batch is registered with an in-memory DuckDB, one SQL statement
cuts, permutes and digests its texts, and the result goes back as Arrow; no
text is touched by Python row by row.

A text is cut into units, each a run of other characters with the white space
before it, or white space at the end; the units are the text.  Four numbers
drawn from the hash of the seed and the identifier say where prefix and middle
end and which form a document takes, so results don't depend on partitions:

    plain   text
    psm     <P> prefix <S> suffix <M> middle
    spm     <S> suffix <P> prefix <M> middle

A text that holds a sentinel itself stays plain, so the first sentinel of each
kind is the one that was put in (no sentinel overlaps itself or another) and
`restored` rebuilds every text exactly.

Defined results: a null text is the empty one, which is plain with no units; a
null identifier draws as the empty string; repeated rows draw alike; an empty
table gives an empty table; extra columns are not read.  Memory is that of one
batch, which a very long text fills alone.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from .common import prepare

SEED = 42
#: Of a hundred documents so many are transformed, and of a hundred of those so many suffix first.
RATE, SPM_RATE = 50, 80
#: Most that one batch's statement may hold in memory.
MEMORY = "1GB"

#: A unit, matched left to right over code points.
UNIT = r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+"

FORMS_SQL = r"""
    WITH drawn AS (
        SELECT doc_id, coalesce(text, '') AS text, sha256('{seed}:' || coalesce(doc_id::VARCHAR, '')) AS h FROM {source}),
    cut AS (
        SELECT doc_id, text, regexp_extract_all(text, '{unit}') AS units, len(units)::BIGINT AS n,
            ('0x' || h[1:8])::BIGINT % (n + 1) AS a, ('0x' || h[9:16])::BIGINT % (n + 1) AS b,
            CASE WHEN n = 0 OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR ('0x' || h[17:24])::BIGINT % 100 >= {rate} THEN 'plain'
                 WHEN ('0x' || h[25:32])::BIGINT % 100 < {spm_rate} THEN 'spm' ELSE 'psm' END AS form FROM drawn),
    parts AS (
        SELECT doc_id, text, n, form,
            CASE WHEN form <> 'plain' THEN coalesce(array_to_string(list_slice(units, 1, least(a, b)), ''), '') END AS prefix,
            CASE WHEN form <> 'plain' THEN coalesce(array_to_string(list_slice(units, least(a, b) + 1, greatest(a, b)), ''), '') END AS middle,
            CASE WHEN form <> 'plain' THEN coalesce(array_to_string(list_slice(units, greatest(a, b) + 1, n), ''), '') END AS suffix FROM cut),
    formed AS (
        SELECT doc_id, n, form, length(prefix)::BIGINT AS prefix_chars, length(middle)::BIGINT AS middle_chars,
            CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || prefix || '<S>' || suffix || '<M>' || middle
                      ELSE '<S>' || suffix || '<P>' || prefix || '<M>' || middle END AS output FROM parts)
    """

#: From the output and its form alone.
RESTORED_SQL = r"""
    CASE form WHEN 'plain' THEN output
        WHEN 'psm' THEN substr(output, 4, instr(output, '<S>') - 4) || substr(output, instr(output, '<M>') + 3) || substr(output, instr(output, '<S>') + 3, instr(output, '<M>') - instr(output, '<S>') - 3)
        ELSE substr(output, instr(output, '<P>') + 3, instr(output, '<M>') - instr(output, '<P>') - 3) || substr(output, instr(output, '<M>') + 3) || substr(output, 4, instr(output, '<P>') - 4) END"""


def forms_sql(source: str, *, seed: int = SEED, rate: int = RATE, spm_rate: int = SPM_RATE) -> str:
    """The statement's common part over a relation `source` (doc_id, text); its last relation is `formed`."""
    return FORMS_SQL.format(source=source, unit=UNIT, seed=int(seed), rate=int(rate), spm_rate=int(spm_rate))


DIGESTS_SQL = f"SELECT doc_id, n, form, prefix_chars, middle_chars, sha256(output) AS output_sha256, sha256({RESTORED_SQL}) AS restored_sha256 FROM formed"


def _in_duckdb(rows: DataFrame, statement: str, schema: str, types: pa.Schema) -> DataFrame:
    """`statement` over every Arrow batch, registered as `batch`."""
    prepare(rows.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import duckdb

        con = duckdb.connect(config={"threads": 1, "memory_limit": MEMORY, "temp_directory": ""})
        try:
            for batch in batches:
                con.register("batch", pa.Table.from_batches([batch]))
                out = con.sql(statement).to_arrow_table().cast(types)
                con.unregister("batch")
                yield from out.to_batches()
        finally:
            con.close()

    return rows.mapInArrow(run, schema)


_COUNTS = [("doc_id", pa.int64()), ("n", pa.int64()), ("form", pa.string()), ("prefix_chars", pa.int64()), ("middle_chars", pa.int64())]
_COUNTS_DDL = "doc_id long, n long, form string, prefix_chars long, middle_chars long"


def _rows(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].alias("text"))


def fill_in_middle(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", seed: int = SEED, rate: int = RATE, spm_rate: int = SPM_RATE) -> DataFrame:
    """(doc_id, n, form, prefix_chars, middle_chars, output) of every document."""
    statement = forms_sql("batch", seed=seed, rate=rate, spm_rate=spm_rate) + "SELECT * FROM formed"
    return _in_duckdb(_rows(docs, id_col, text_col), statement, f"{_COUNTS_DDL}, output string", pa.schema([*_COUNTS, ("output", pa.string())]))


def restored(formed: DataFrame) -> DataFrame:
    """(doc_id, text): the texts that (doc_id, form, output) were made from."""
    statement = f"SELECT doc_id, {RESTORED_SQL} AS text FROM batch"
    return _in_duckdb(formed.select("doc_id", "form", "output"), statement, "doc_id long, text string", pa.schema([("doc_id", pa.int64()), ("text", pa.string())]))


def fill_in_middle_digests(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", seed: int = SEED, rate: int = RATE, spm_rate: int = SPM_RATE) -> DataFrame:
    """As `fill_in_middle`, with SHA-256 of the output and of the text rebuilt from it in place of the output."""
    statement = forms_sql("batch", seed=seed, rate=rate, spm_rate=spm_rate) + DIGESTS_SQL
    digests = [("output_sha256", pa.string()), ("restored_sha256", pa.string())]
    return _in_duckdb(_rows(docs, id_col, text_col), statement, f"{_COUNTS_DDL}, output_sha256 string, restored_sha256 string", pa.schema([*_COUNTS, *digests]))
