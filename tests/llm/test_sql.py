"""The queries that SQL can say give the SQL's rows, on the smallest tables and on odd rows."""

import glob
import random
from pathlib import Path

import duckdb
import pytest

from attestry.llm import chat, queries

DATA = "/root/testdata/sf0.001"


def same(df, relation):
    names = sorted(df.columns)
    assert names == sorted(relation.columns)
    found = sorted(map(str, ([r[c] for c in names] for r in df.collect())))
    wanted = sorted(map(str, map(list, relation.select(*[duckdb.ColumnExpression(c) for c in names]).fetchall())))
    assert found == wanted and found


@pytest.mark.skipif(not Path(DATA).exists(), reason="needs the driver's tables")
@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_same_rows_as_sql(spark, name):
    duck = duckdb.connect()
    for f in glob.glob(f"{DATA}/*.parquet"):
        duck.sql(f"CREATE VIEW {Path(f).stem} AS SELECT * FROM '{f}'")
    same(queries.queries()[name](spark, DATA), duck.sql(queries.oracle_sql()[name]))


def test_chat_sql_on_odd_rows(spark, tmp_path):
    odd = [(1, 0, "user", "Hello there.\nHow are you?\n\nSecond   paragraph."), (1, 1, None, "I am fine."), (1, 2, "user", "> how are  you?\nYes!\n"), (1, 3, "a", ">> How are you?\n> Yes!\nGood"), (1, 3, "a", ">> How are you?\n> Yes!\nGood"), (2, None, "x", None), (None, 0, None, "> nope\n"), (None, 1, "b", "nope"), (None, 2, "b", "> nope\r\nso"), (2, 0, "a", ">>> a\n> b\nc"), (2, 5, "a", "")]
    odd += [(7, k, "u", (f"> line {k - 1}\n" if k else "") + f"line {k}") for k in range(70)]
    df = spark.createDataFrame(odd, "conv_id long, turn long, role string, text string")
    df.write.parquet(f"{tmp_path}/c")
    duck = duckdb.connect()
    duck.sql(f"CREATE VIEW conversations AS SELECT * FROM '{tmp_path}/c/*.parquet'")
    same(chat.formatted(df), duck.sql(chat.ORACLE_SQL))


def conversations(r, n, longest):
    """Turns that quote earlier ones, nested, in part, with other blanks and case; repeated passages; a few long threads."""
    said = [f"{r.choice(['Well', 'So', 'Now'])} {r.choice(['it', 'this', 'that'])} is passage {k}." for k in range(400)]
    rows = []
    for conv in range(n):
        size = longest if conv % 50 == 0 else r.randint(1, 30)
        texts = []
        for turn in range(size):
            lines = []
            at = turn
            for level in range(1, r.choice([1, 1, 2, 3, 4])):
                if not at:
                    break
                at = r.randrange(max(0, at - 12), at)
                own = [x for x in texts[at].split("\n") if not x.startswith(">")]
                part = own if r.random() < 0.6 else [r.choice(own)]
                lines = [">" * level + r.choice(["", " "]) + (x.upper() if r.random() < 0.1 else x.replace(" ", "  ") if r.random() < 0.1 else x) for x in part] + lines
            lines += [r.choice(said) for _ in range(r.randint(1, 3))] + ([""] + [r.choice(said)] if r.random() < 0.3 else []) + [f"turn {turn} of {conv}"] * (r.random() < 0.8)
            texts.append("\n".join(lines))
            rows.append((conv, turn, r.choice(["user", "assistant", None]), texts[-1]))
            if r.random() < 0.01:
                rows.append(rows[-1])
    return rows


@pytest.mark.parametrize("n,longest", [(3000, 400)])
def test_chat_sql_on_tables_with_quotes(spark, tmp_path, n, longest):
    rows = conversations(random.Random(5), n, longest)
    assert len(rows) > 50_000 and sum(">" in x[3] for x in rows) > 20_000
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    df.write.parquet(f"{tmp_path}/c")
    duck = duckdb.connect()
    duck.sql(f"CREATE VIEW conversations AS SELECT * FROM '{tmp_path}/c/*.parquet'")
    found = chat.formatted(spark.read.parquet(f"{tmp_path}/c"))
    same(found, duck.sql(chat.ORACLE_SQL))
    assert found.agg({"n_linked": "sum"}).first()[0] > 15_000
