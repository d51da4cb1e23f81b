import random

import duckdb

from sheaf.llm import chat


def plain(rows):
    nil = lambda x: (x is not None, x)
    talks = {}
    for conv, turn, role, text in sorted(set(rows), key=lambda r: [nil(x) if x is not None else (False, 0) for x in r[:2]] + [nil(x) if x is not None else (False, "") for x in r[2:]]):
        talks.setdefault(conv, []).append((role, text))
    out = []
    for conv, turns in talks.items():
        twin = any(other == turns and nil(c) < nil(conv) if None in (c, conv) else other == turns and c < conv for c, other in talks.items() if c != conv)
        if twin or any(len(o) > len(turns) and o[: len(turns)] == turns for o in talks.values()):
            continue
        for place, (role, text) in enumerate(turns, 1):
            out.append((conv, place, role, f"<|im_start|>{role or ''}\n{text or ''}<|im_end|>\n"))
    return sorted(out, key=repr)


def ours(spark, rows):
    df = spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string").repartition(3)
    return sorted((tuple(r) for r in chat.format_chat(df).collect()), key=repr)


def made(seed):
    r = random.Random(seed)
    rows, conv = [], 0
    for _ in range(25):
        turns = [(r.choice(["user", "assistant", None]), r.choice(["a", "b", "", None, "long " * 50])) for _ in range(r.randrange(1, 7))]
        for n in range(r.choice([1, len(turns)]), len(turns) + 1):
            for _ in range(r.choice([1, 1, 2])):
                first, gap = r.choice([0, 0, 5000]), r.choice([1, 1, 700])
                rows += [(conv, first + gap * t, *x) for t, x in enumerate(turns[:n])]
                conv += 1
    rows += [(900, None, "user", "no turn"), (900, 0, "user", "x"), (900, 0, "assistant", "tie"), (None, 0, "user", "null id"), rows[0], rows[0]]
    return rows


def test_equal_to_plain_collapse(spark):
    for seed in (1, 2):
        assert ours(spark, made(seed)) == plain(made(seed))


def test_long_conversation_and_its_snapshots(spark):
    turns = [(t, "user" if t % 2 == 0 else "assistant", f"turn {t}") for t in range(3000)]
    rows = [(1, *x) for x in turns] + [(2, *x) for x in turns[:2500]] + [(3, *x) for x in turns[:2499]] + [(3, 2499, "assistant", "differs")]
    got = ours(spark, rows)
    assert {c for c, *_ in got} == {1, 3} and len(got) == 5500


def test_empty_table_and_other_columns(spark):
    assert ours(spark, []) == []
    df = spark.createDataFrame([(1, 0, "user", "x", 7, 8)], "conv_id bigint, turn bigint, role string, text string, place int, p int")
    assert chat.format_chat(df).count() == 1


def test_smallest_table_and_sql(spark, sf_dir):
    df = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    rows = [tuple(r) for r in df.select("conv_id", "turn", "role", "text").collect()]
    got = ours(spark, rows)
    assert got == plain(rows)
    con = duckdb.connect()
    con.execute(f"CREATE VIEW conversations AS SELECT * FROM '{sf_dir}/conversations.parquet'")
    assert sorted(con.execute(chat.SQL).fetchall(), key=repr) == got
