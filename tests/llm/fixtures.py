"""A small corpus with every awkward case, and slow, plain versions of what operators compute."""

import random
import re

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
ASCII = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words(text):
    return WORD.findall((text or "").translate(ASCII))


def prose(seed, n, stems=("ka", "lo", "mi", "ren", "tus", "ve", "é", "dor")):
    rng = random.Random(seed)
    return " ".join("".join(rng.choice(stems) for _ in range(rng.randint(1, 4))) for _ in range(n))


def edited(text, seed, n):
    rng, w = random.Random(seed), text.split()
    for _ in range(n):
        w[rng.randrange(len(w))] = "edit" + str(rng.randrange(10**6))
    return " ".join(w)


BASE = prose(1, 300)
PASSAGE = prose(2, 80)
ITEM, SHORT_ITEM = prose(3, 30), "kalo mimi"


def corpus():
    """(doc_id, text) rows."""
    rows = [(None, None), (1, None), (2, ""), (3, " \t\n"), (4, "..!?"), (5, "one"), (6, "One two three"), (6, "One two three")]
    rows += [(10, BASE), (11, BASE), (12, BASE + " "), (13, BASE.upper().replace("É", "é"))]
    rows += [(20 + i, edited(BASE, i, 3)) for i in range(25)]
    rows += [(50, prose(50, 120) + " " + PASSAGE + " " + prose(51, 100)), (51, prose(52, 40) + "\n" + PASSAGE + ". " + prose(53, 90)), (52, prose(54, 70) + " " + edited(PASSAGE, 9, 2) + " " + prose(55, 20))]
    rows += [(60, prose(60, 40) + " " + ITEM + " " + prose(61, 10)), (61, "Kalo, MIMI"), (62, " ".join(ITEM.split()[4:15])), (63, " ".join(ITEM.split()[:9]))]
    rows += [(70, prose(70, 9000)), (71, "x" * 5000), (72, "ka " * 3000), (None, prose(73, 60)), (None, prose(73, 60))]
    return rows


def frame(spark, rows=None):
    """The corpus with extra columns whose names operators use themselves."""
    rows = corpus() if rows is None else rows
    return spark.createDataFrame([(i, t, "x", 1, None) for i, t in rows], "doc_id long, text string, key string, n int, id string")


def bench(spark):
    return spark.createDataFrame([(7, ITEM, 0), (None, ITEM, 0), (8, SHORT_ITEM, 0), (9, "", 0), (10, None, 0), (7, ITEM, 1)], "item_id long, text string, words int")
