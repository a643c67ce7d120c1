import math
import os
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from docquarry.llm import chat

SF = "/root/testdata/sf0.1"


def turns(spark, n=900):
    rng = np.random.default_rng(3)
    rows = []
    for conv in range(60):
        for turn in range(n if conv == 7 else int(rng.integers(2, 9))):
            role = "system" if turn == 0 and conv % 5 == 0 else ("user", "assistant")[turn % 2]
            text = "ask " * int(rng.integers(1, 30)) if role == "user" else "tell me\n" * int(rng.integers(5, 60))
            rows.append((conv, turn, role, text, "x"))
    return spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, found_role string")


def best_path(model, seen):
    """The best score of all paths, by plain dynamic programming over whole conversations."""
    scores = [model["first"][r] + chat.emission(model, seen[0])[r] for r in range(3)]
    for s in seen[1:]:
        scores = [max(scores[p] + model["move"][p][r] for p in range(3)) + chat.emission(model, s)[r] for r in range(3)]
    return max(scores)


def test_paths_over_many_tasks_are_the_best(spark):
    df = turns(spark)
    model = chat.count_model(df)
    spark.conf.set("spark.sql.shuffle.partitions", "16")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        rows = chat.recover_roles(df, model).collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    assert len(rows) == df.count()
    seen = {(r.conv_id, r.turn): r.seen for r in df.select("conv_id", "turn", chat.observation(df.text).alias("seen")).collect()}
    by = {}
    for r in sorted(rows, key=lambda r: (r.conv_id, r.turn)):
        by.setdefault(r.conv_id, []).append(r)
    for conv, own in by.items():
        path, shows = [chat.ROLES.index(r.found_role) for r in own], [seen[conv, r.turn] for r in own]
        total = model["first"][path[0]] + sum(model["move"][a][b] for a, b in zip(path, path[1:])) + sum(chat.emission(model, s)[p] for s, p in zip(shows, path))
        assert math.isclose(total, best_path(model, shows), abs_tol=1e-6)
    assert sum(r.role == r.found_role for r in rows) / len(rows) > 0.95


def joined(rows):
    by = {}
    for r in sorted(rows, key=lambda r: (r.conv_id, r.turn, r.line)):
        by.setdefault(r.conv_id, []).append(r)
    return by


def test_transcripts_are_parsed_and_rendered(spark):
    """Pieces join to turns of one role each, whatever tasks the lines are dealt to; most roles come back."""
    df = turns(spark, 300)
    lines = chat.transcribed(df.withColumn("text", F.regexp_replace("text", "\n", "?\n\n")))
    spark.conf.set("spark.sql.shuffle.partitions", "16")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        rows = chat.recover_roles(lines).collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    assert len(rows) == lines.count() and {r.held_out for r in rows} == {True, False}
    texts = {(r.conv_id, r.turn, r.line): chat._MARK.sub("", r.text).strip() for r in lines.collect()}
    for conv, own in joined(rows).items():
        want, was = [], None
        for r in own:
            assert r.starts_turn == (r.found_role != was)
            if r.found_role != was:
                want.append(f"<|{r.found_role}|>")
            want.append(texts[conv, r.turn, r.line])
            was = r.found_role
        plain = "\n".join(want).replace("\n<|", "<|end|>\n<|") + "<|end|>"
        assert "".join(r.rendered for r in own) == plain
    held = [r for r in rows if r.held_out]
    assert sum(r.role == r.found_role for r in held) / len(held) > 0.9


def test_counted_model(spark):
    """Shares counted one by one over the lines of training conversations."""
    lines = chat.transcribed(turns(spark, 20).where("conv_id < 30"))
    own = joined(lines.where(chat.in_training(F.col("conv_id"))).withColumn("seen", chat.observation(F.col("text"))).collect())
    move, show, first = Counter(), Counter(), Counter()
    for rows in own.values():
        first[rows[0].role] += 1
        move.update((a.role, b.role) for a, b in zip(rows, rows[1:]))
        show.update((r.role, r.seen) for r in rows)
    model, seen = chat.count_model(lines), sorted({s for _, s in show})
    assert sorted(model["show"]) == seen
    for i, r in enumerate(chat.ROLES):
        assert math.isclose(model["first"][i], math.log((first[r] + 1) / (sum(first.values()) + 3)))
        for k, to in enumerate(chat.ROLES):
            assert math.isclose(model["move"][i][k], math.log((move[r, to] + 1) / (sum(n for (a, _), n in move.items() if a == r) + 3)))
        for s in seen:
            assert math.isclose(model["show"][s][i], math.log((show[r, s] + 1) / (sum(n for (a, _), n in show.items() if a == r) + len(seen) + 1)))


def test_markers_and_odd_rows(spark):
    assert chat.rendered("Q: hi <|end|>", "user", None, True) == "<|user|>\nhi < |end|><|end|>"
    assert chat.rendered("x", "user", "user", False) == "\nx" and chat.rendered("", "user", "system", False) == "<|end|>\n<|user|>\n"
    text = "System: be kind\nUser: hello there?\r\nAssistant: good day\nand more\n\nUser: thanks"
    lines = chat.lines_of(spark.createDataFrame([(1, text), (2, None), (3, "")], "conv_id long, text string"))
    known = [(c, t, r, x) for c in range(80) for t, (r, x) in enumerate([("system", "be kind"), ("user", "who is there?"), ("assistant", "a reply\nof two lines"), ("user", "thanks")])]
    model = chat.count_model(chat.transcribed(spark.createDataFrame(known, "conv_id long, turn long, role string, text string")))
    got = [(r.conv_id, r.line, r.found_role) for r in sorted(chat.recover_roles(lines, model).collect(), key=lambda r: (r.conv_id, r.line))]
    assert [g[1:] for g in got if g[0] == 1 and g[1] != 3] == [(0, "system"), (1, "user"), (2, "assistant"), (4, "user")] and len(got) == 7
    odd = spark.createDataFrame([(None, 1, None, None), (None, None, "user", "x"), (1, 1, "user", "same"), (1, 1, "user", "same"), (2, 0, "other", ""), (3, 0, "user", "long " * 100_000), (3, 1, "user", "l\n" * 30_000)], "conv_id long, turn long, role string, text string")
    assert chat.recover_roles(odd).count() == 7 and chat.recover_roles(odd.limit(0)).count() == 0
    assert chat.recover_roles(chat.transcribed(odd)).count() == 6 + 30_000 and chat.recover_roles(chat.transcribed(odd.limit(0))).count() == 0
    clash = odd.withColumns({"name": F.lit("n"), "seen": F.lit("s"), "found_role": F.lit("f")})
    assert chat.recover_roles(chat.transcribed(clash)).count() == 6 + 30_000


@pytest.mark.skipif(not os.path.isdir(SF), reason="needs the test tables")
def test_roles_of_unseen_conversations(spark):
    rows = chat.recover_roles(chat.transcribed(spark.read.parquet(f"{SF}/conversations.parquet"))).where("held_out").collect()
    right, commonest = sum(r.role == r.found_role for r in rows), Counter(r.role for r in rows).most_common(1)[0][1]
    assert right / len(rows) > 0.8 and right > 1.2 * commonest
