"""Tables with awkward rows, and ways to compare results."""

from __future__ import annotations

import duckdb
import pandas as pd

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
PROSE = "The river runs past the old mill and under the stone bridge where children fish in summer. " * 6
LONG = " ".join(f"w{i % 997}x{i % 13}" for i in range(60_000))
ROWS = [
    (1, None, "en", "a", None),
    (2, "", None, None, 0),
    (3, " \n\t ", "en", None, 4),
    (4, PROSE, "en", "a", 1),
    (5, PROSE, "en", "b", 1),
    (5, PROSE, "en", "b", 1),
    (6, PROSE.replace("bridge", "arch", 1), "en", "a", 1),
    (7, "12345 !!! ???", "de", "a", 1),
    (8, LONG, "fr", "a", 1),
    (9, "éàü ß 日本語 😀 " * 30, None, "c", 1),
    (None, "no id here", "en", "a", 1),
    (10, "a\r\nb\x0b c", "en", "a", 1),
]


def docs(spark, rows=ROWS):
    return spark.createDataFrame(rows, SCHEMA)


def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def clashing(df, *names):
    """df with columns of these names, in odd case, that an operator also makes."""
    for n in names:
        df = df.withColumn(n.upper() if len(n) % 2 else n, df["doc_id"].cast("string"))
    return df


def against(got, sql: str, sf: str = SF) -> None:
    con = duckdb.connect()
    for t in ("documents", "pages"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf}/{t}.parquet')")
    same(got.toPandas(), con.sql(sql).fetchdf())


def same(got: pd.DataFrame, want: pd.DataFrame) -> None:
    cols = sorted(want.columns)
    assert sorted(got.columns) == cols and len(got) == len(want)

    def plain(df):
        numbers = lambda c: c.astype(float) if pd.api.types.is_numeric_dtype(c) and not pd.api.types.is_bool_dtype(c) else c.astype(object).where(c.notna(), None).astype(str)
        return df[cols].apply(numbers).fillna(-1e99).sort_values(cols).reset_index(drop=True)

    pd.testing.assert_frame_equal(plain(got), plain(want), check_dtype=False)
