import hashlib
import re
import zlib
from collections import defaultdict

import corpus_pipeline
import numpy as np
import pytest
import __spark_entry__ as entry
from tokenizers import Tokenizer

from sealcol.llm import queries

from .fixtures import BASE, ITEM, bench, edited, prose, words
from .test_operators import brute_groups, brute_secrets, brute_windows


def table(spark):
    texts = [(i, prose(i, 80)) for i in range(40)] + [(100, BASE), (101, BASE + "\n"), (102, edited(BASE, 1, 2)), (103, prose(103, 30) + " " + ITEM), (104, None), (105, "123"), (106, ""), (107, "?!"), (None, prose(107, 60))]
    return spark.createDataFrame([(i, t, "xx", "s", len(t or "")) for i, t in texts], "doc_id long, text string, lang string, source string, n_chars long"), texts


def test_stages_do_what_brute_force_does(spark, tmp_path):
    docs, texts = table(spark)
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    bench(spark).select("item_id", "text").write.parquet(str(tmp_path / "benchmark.parquet"))
    sf = str(tmp_path)
    left, now = [t for t in texts if re.search(r"[^\W\d_]", t[1] or "")], docs
    kept = []
    for name, stage in corpus_pipeline.STAGES[:-1]:
        now = stage(spark, now, sf)
        assert now.columns == docs.columns, name
        now.write.parquet(str(tmp_path / name))
        now = spark.read.parquet(str(tmp_path / name))
        kept.append(sorted((str(r["doc_id"]), r["text"]) for r in now.collect()))
    want = [left]
    best = {}
    for i, t in left:
        key = re.sub("[\x20\x09-\x0d]", "", t)
        if key not in best or (-len(t), i is None, i) < (-len(best[key][1]), best[key][0] is None, best[key][0]):
            best[key] = (i, t)
    want.append(list(best.values()))
    sets, _, low, root = brute_groups(want[-1])
    want.append([(i, t) for (i, t), s in zip(want[-1], sets) if i == low[s] or (i is None and low[s] is None)])
    clean = {i for i, _, n, _ in brute_windows(want[-1], [(r["item_id"], r["text"]) for r in bench(spark).collect()]) if not n}
    want.append([(i, t) for i, t in want[-1] if str(i) in clean])
    assert kept == [sorted((str(i), t) for i, t in w) for w in want]
    pieces = corpus_pipeline.run(spark, sf)
    assert {str(r["doc_id"]) for r in pieces.select("doc_id").distinct().collect()} == clean
    # each piece holds the ids that the tokenizer gives its document there; documents and sequences have no gaps
    plain = Tokenizer.from_file(queries.vocabulary("word_bpe_49k.json"))
    text = {str(i): t for i, t in want[-1]}
    of_doc, of_sequence = defaultdict(list), defaultdict(list)
    for r in pieces.collect():
        ids = plain.encode(text[str(r["doc_id"])], add_special_tokens=False).ids + [1]
        own = np.array(ids[r["start"] : r["start"] + r["length"]], "<u4")
        assert (len(own), zlib.crc32(own.tobytes()), len(ids)) == (r["length"], r["ids_crc32"], r["doc_tokens"])
        of_doc[r["doc_id"], len(ids)].append((r["start"], r["length"]))
        of_sequence[r["sequence_id"], None].append((r["offset"], r["length"]))
    for (_, n), parts in [*of_doc.items(), *of_sequence.items()]:
        at = 0
        for start, length in sorted(parts):
            assert start == at
            at += length
        assert at <= 2048 if n is None else at == n
    assert words(BASE)


def test_stages_over_no_documents(spark, tmp_path):
    table(spark)[0].limit(0).write.parquet(str(tmp_path / "documents.parquet"))
    bench(spark).select("item_id", "text").write.parquet(str(tmp_path / "benchmark.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_registration():
    names = list(entry.queries())
    assert [n for n in names if re.match(r"op\d+_", n)] == sorted((n for n in names if re.match(r"op\d+_", n)), key=lambda n: int(re.findall(r"\d+", n)[0]))
    assert {int(re.findall(r"\d+", n)[0]) for n in names if re.match(r"op\d+_", n)} == set(range(1, 14))
    assert "pipeline" in names and set(entry.oracle_sql()) <= set(names)


SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def documents(spark):
    return {r["doc_id"]: r for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}


def test_op2_columns(spark, documents):
    got = {r["doc_id"]: r for r in queries.op2_quality_classifier(spark, SF).collect()}
    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    assert got.keys() == documents.keys()
    assert all(r["held_out"] == (zlib.crc32(str(i).encode()) % 3 == 1) and r["predicted"] == (r["score"] >= 0.5) and 0 <= r["score"] <= 1 for i, r in got.items())
    held = [i for i, r in got.items() if r["held_out"] and labels.get(i) is not None]
    assert sum(got[i]["predicted"] == labels[i] for i in held) > 0.9 * len(held)


def test_op6_and_op8_columns(spark, documents):
    tokenizer = Tokenizer.from_file(queries.vocabulary("word_bpe_49k.json"))
    ids = {i: np.array(tokenizer.encode(r["text"] or "", add_special_tokens=False).ids + [1]) for i, r in documents.items()}
    pieces, sequences, seen = queries.op6_packing(spark, SF).collect(), defaultdict(list), defaultdict(int)
    for r in pieces:
        part = ids[r["doc_id"]][r["start"] : r["start"] + r["length"]]
        assert len(part) == r["length"] and r["doc_tokens"] == len(ids[r["doc_id"]]) and r["ids_crc32"] == zlib.crc32(part.astype("<u4").tobytes())
        sequences[r["sequence_id"]].append((r["offset"], r["length"]))
        seen[r["doc_id"]] += r["length"]
    assert seen == {i: len(x) for i, x in ids.items()}
    for own in sequences.values():
        own.sort()
        assert [a for a, _ in own] == [0, *np.cumsum([n for _, n in own])[:-1].tolist()] and own[-1][0] + own[-1][1] <= 2048
    total = sum(map(sum, ([n for _, n in own] for own in sequences.values())))
    padded = sum(0 if (n := own[-1][0] + own[-1][1]) & (n - 1) == 0 else 2048 - n for own in sequences.values())
    assert total == sum(map(len, ids.values())) and padded < 0.01 * total
    rows = queries.op8_token_id_output(spark, SF).collect()
    assert sorted((d, s, b - a) for r in rows for d, s, a, b in zip(r["doc_ids"], r["starts"], r["cu_seqlens"], r["cu_seqlens"][1:])) == sorted((i, a, min(2048, len(x) - a)) for i, x in ids.items() for a in range(0, len(x), 2048))


def test_op9_columns(spark, documents):
    got = {r["doc_id"]: r for r in queries.op9_language_id(spark, SF).collect()}
    assert got.keys() == documents.keys() and all(r["held_out"] == (zlib.crc32(str(i).encode()) % 4 == 2) for i, r in got.items())
    for i, r in documents.items():
        assert (got[i]["lang_pred"] == "und") == (not any(c.isalpha() for c in r["text"] or ""))
    held = [i for i, r in got.items() if r["held_out"] and documents[i]["lang"] and r["lang_pred"] != "und"]
    assert sum(got[i]["lang_pred"] == documents[i]["lang"] for i in held) > 0.95 * len(held)


def test_op10_columns(spark, documents):
    kinds = ("assign", "access", "hex")
    for r in queries.op10_secret_scan(spark, SF).collect():
        want = brute_secrets(documents[r["doc_id"]]["text"])
        assert [r[f"n_{k}"] for k in kinds] == [sum(x[1] == n for x in want) for n in range(3)]
        base = [f"{kinds[k]}:{a}:{b}" for a, k, b in want]
        assert r["base_sha256"] == hashlib.sha256(",".join(base).encode()).hexdigest()
        assert [x for x in r["spans"].split(",") if x and not x.startswith("random")] == base
