"""Turns with one number follow each other by role and whole text."""

import hashlib

from speechspark.llm.chat import MESSAGE, events_of_rows, fold_events, read_back, render


def test_tied_turns_that_differ_late(spark):
    same = "the same sixty-four characters and more stand at the beginning of all of these "
    texts = [same + x for x in ("b", "a", "c<|im_end|>", "a", "!", "c<", "")] + ["short", ""]
    rows = [(1, 5, role, t) for t in texts for role in ("user", "assistant")] + [(1, 2, "user", "z"), (2, 5, "user", same + "b")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(5)
    got = {r["conv"]: r for r in read_back(render(fold_events(events_of_rows(df), MESSAGE))).collect()}
    for conv in (1, 2):
        turns = sorted((t, role, text) for c, t, role, text in rows if c == conv)
        assert got[conv]["n_turns"] == len(turns)
        assert got[conv]["turns_sha256"] == hashlib.sha256("".join(f"{r}\n{t}\n" for _, r, t in turns).encode()).hexdigest()
        learned = "".join(t for _, r, t in turns if r == "assistant")
        assert got[conv]["loss_sha256"] == hashlib.sha256(learned.encode()).hexdigest()
