"""The rows of the whole pipeline against each stage done plainly, one document after another."""

import collections
import hashlib
import math
import re
import zlib
from array import array

import corpus_pipeline
from ledgerlift.llm import toxicity
from ledgerlift.llm.store import documents, labels
from ledgerlift.llm.tokens import default_path, tokenizer

from .test_copies import brute_components
from .test_quality import water

SF_DIR = "/root/testdata/sf0.001"


def words_of(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def toxic_score(text, model):
    words = words_of(text)
    known = {}
    for i, word in enumerate(words):
        score = next((model.scores[t] for t in toxicity.tokens_of(word) if t in model.scores), None)
        if score is not None:
            known[i] = score
    found = toxicity.segments(list(known), list(known.values()), model.other)  # tested against its definition
    chance = math.log(max(model.scale, 1e-12) * max(len(words), 1))
    x = math.log1p(sum(max(0.0, model.decay * s - chance) for _, _, s in found))
    return 1 / (1 + math.exp(-(model.intercept + model.slope * x)))


def n_words(text):
    return len(words_of(text))


def mixed_copies(rows):
    """How often the mix takes each document whole."""
    sizes = collections.Counter()
    for _, text, source in rows:
        sizes[source] += n_words(text)
    order = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    targets = water(sizes, {s: 1 + i % 3 for i, s in enumerate(order)}, 3)
    out = []
    for source in order:
        mine = [(i, text, hashlib.md5(f"17:{'' if i is None else i}:{source or ''}".encode()).hexdigest()) for i, text, s in rows if s == source]
        whole = min(math.floor(targets[source] / sizes[source]), 3) if sizes[source] else 0
        left = max(round(targets[source] - whole * sizes[source]), 0)
        groups = collections.defaultdict(list)
        for i, text, key in mine:
            groups[int(key[:3], 16), int(key[3:6], 16)].append((i, text))
        for key in sorted(groups):
            size = sum(n_words(t) for _, t in groups[key])
            take = min(size, left)
            left -= take
            for i, text in groups[key]:
                n = n_words(text)
                out += [(i, text)] * ((n * whole + (n * take // size if size else 0)) // n if n else 1)
    return out


def with_toxic_rows(spark, sf_dir):
    """The tables of the smallest size with other documents, half of them toxic and most of them labelled."""
    more = documents(spark, "/root/testdata/sf0.01").where("doc_id >= 500 AND doc_id < 740 AND length(text) > 200").orderBy("doc_id").collect()
    extra = [(10_000 + i, f"{r.text[:len(r.text) // 2]} vile scum idiots {r.text[len(r.text) // 2:]}" if i % 2 else r.text, r.lang, r.source, 1) for i, r in enumerate(more)]
    marks = [(10_000 + i, 1, i % 2) for i in range(len(more)) if i % 5]
    docs, known = documents(spark, SF_DIR), labels(spark, SF_DIR)
    docs.unionByName(spark.createDataFrame(extra, docs.schema)).write.parquet(f"{sf_dir}/documents.parquet")
    known.unionByName(spark.createDataFrame(marks, known.schema)).write.parquet(f"{sf_dir}/labels.parquet")
    return [i for i, *_ in extra[1::2]]


def test_pipeline_rows(spark, tmp_path):
    sf_dir = str(tmp_path)
    planted = with_toxic_rows(spark, sf_dir)
    docs = documents(spark, sf_dir)
    rows = [(r.doc_id, r.text, r.source) for r in docs.collect()]
    model = toxicity.toxicity_model(docs, labels(spark, sf_dir))
    clean = [r for r in rows if toxic_score(r[1], model) < 0.7]
    assert {r[0] for r in rows} - {r[0] for r in clean} >= set(planted) and len(clean) >= len(rows) - 1.3 * len(planted)
    last = {}
    for r in clean:
        last[r[1] or ""] = max(last.get(r[1] or "", r), r, key=lambda x: x[0])
    distinct = sorted(last.values())
    groups = brute_components(distinct, 5, 80)
    kept = {i for i, n, comp in groups if not n or i == comp}
    near = [r for r in distinct if str(r[0]) in kept]
    assert len(near) < len(distinct) < len(clean)
    copies = mixed_copies(near)
    wanted = collections.Counter(i for i, _ in copies)
    tok, ids = tokenizer(default_path("word_bpe_49k.json")), {}
    for i, text in copies:
        ids[i] = ids.get(i) or [*tok.encode(text or "", add_special_tokens=False).ids, 1]

    pieces = corpus_pipeline.run(spark, sf_dir).collect()
    held = collections.Counter()
    places = collections.defaultdict(list)
    for p in pieces:
        assert p.doc_tokens == len(ids[p.doc_id])
        part = array("I", ids[p.doc_id][p.start:p.start + p.length]).tobytes()
        assert len(part) == 4 * p.length and zlib.crc32(part) == p.ids_crc32
        held[p.doc_id] += p.length
        places[p.sequence_id].append((p.offset, p.length))
    assert held == {i: n * len(ids[i]) for i, n in wanted.items()}
    covered = collections.Counter((p.doc_id, at) for p in pieces for at in range(p.start, p.start + p.length))
    assert all(covered[i, at] == n for i, n in wanted.items() for at in range(len(ids[i])))
    for spans in places.values():
        spans.sort()
        assert spans[0][0] == 0 and all(a + n == b for (a, n), (b, _) in zip(spans, spans[1:])) and sum(spans[-1]) <= 2048
