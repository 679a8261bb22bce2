"""Quality rules against plain Python, on labelled documents and odd rows."""

import random
import re

from scanloom.llm.quality import quality_rules
from scanloom.llm.queries import QUERIES
from tests.llm.support import docs_frame, prose, write_documents

WORD = re.compile("[^\x20\x09-\x0D]+")
rng = random.Random(3)
ROWS = [(1, None), (2, ""), (3, "\n\n \n"), (4, "a b c a b c"), (5, "one two"), (6, "x\ny\nx\nx \n"), (7, "é ü | # %" * 30), (7, "é ü | # %" * 30),
        (None, prose(rng, 80)), (8, "w. " * 60), (9, " ".join(f"k{i}" for i in range(5000)) + "."),
        *((20 + i, prose(rng, rng.randrange(40, 400), rng.choice([20, 400]))) for i in range(30))]


def base(text):
    words = WORD.findall(text or "")
    triples = [tuple(words[i:i + 3]) for i in range(len(words) - 2)]
    count = {}
    for t in triples:
        count[t] = count.get(t, 0) + 1
    covered = {i + k for i, t in enumerate(triples) if count[t] > 1 for k in range(3)}
    lines = [x for x in (text or "").split("\n") if WORD.search(x)]
    return (len(words), sum(map(len, words)), len(re.findall("[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), len(covered),
            len(words) < 50 or 100 * len(covered) > 50 * len(words))


def test_base_measures(spark, tmp_path):
    out = QUERIES["op3_quality_rules"](spark, write_documents(spark, tmp_path, ROWS)).collect()
    got = sorted((r["doc_id"] or 0, r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"], r["base_failed"]) for r in out)
    assert got == sorted((i or 0, *base(t)) for i, t in ROWS)
    assert not any(r["kept"] and r["base_failed"] for r in out)


def test_lines(spark):
    good = "A sentence that has an end, as it should. " * 8
    lines = ["A line of words without any end to it", "Home | News | About | Contact.", "Stop!! Now!! Go!! Here!!", "a### b*** c$$$ d.", "All rights reserved.", good, ""]
    row = quality_rules(docs_frame(spark, [(1, "\n".join([good, *lines]))])).first()
    assert row["cleaned"] == "\n".join([good, good, ""])
    text = " ".join(f"plain{i} word{i} here{i}." for i in range(30))
    row = quality_rules(docs_frame(spark, [(1, text + "\nAll rights reserved.")])).first()
    assert row["kept"] and row["cleaned"] == text
    row = quality_rules(docs_frame(spark, [(1, text + "\n" + " | ".join(f"item{i}" for i in range(100)))])).first()
    assert not row["kept"] and not row["base_failed"]


def test_labelled_documents(spark):
    folder = "/root/testdata/sf0.01"
    out = QUERIES["op3_quality_rules"](spark, folder).join(spark.read.parquet(f"{folder}/labels.parquet"), "doc_id").toPandas()
    assert not out[(out.quality == 0) & out.kept].shape[0]
    assert out[(out.quality == 1) & ~out.base_failed].kept.all()


def test_clashing_and_empty(spark):
    frame = docs_frame(spark, [(1, "x")]).selectExpr("*", "1 as kept", "2 as __odd", "3 as n_words")
    assert quality_rules(frame).columns == [*docs_frame(spark, [(1, "x")]).columns, "__odd", "n_words", "word_chars", "n_symbols", "n_dup_lines",
                                            "n_repeat_words", "base_failed", "cleaned", "kept"]
    assert quality_rules(docs_frame(spark, [])).collect() == []
