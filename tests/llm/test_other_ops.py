"""Packing, chat repair, id files, revisits, URL rules and the pipeline."""

import itertools
import random
import zlib

import numpy as np
import pytest
from conftest import DATA
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from flowledger.llm import chat, components, idcodec, packing, tokens, urlfilter, warc

TOKENIZER = Tokenizer.from_file(tokens.public_path())
LONG = " ".join(f"word{i}" for i in range(9000))
TEXTS = [(1, "Hello world, hello again.\n\n  two  spaces\tand tabs "), (2, None), (3, ""), (4, LONG), (5, "naïve 木😀 <|endoftext|> x"), (5, "again"), (None, "no id"), (7, "a   b\x1c\x0bc"), (8, "x" * 5000), (9, "again")]


def ids_of(text):
    return [*TOKENIZER.encode(text or "", add_special_tokens=False).ids, 0]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(*r, 3, b"x") for r in TEXTS], "doc_id long, text string, length int, ids binary")


def test_cached_encoding_equals_the_library():
    encode = tokens.Encoder(tokens.public_path(), remembered=50)
    texts = [t for _, t in TEXTS] + ["".join(random.Random(i).choices("ab \n\t.,'s1é 　", k=300)) for i in range(150)]
    texts += ["".join(random.Random(i).choices("ab \n\t\r\x0b\x0c\x1c\x85\xa0\u1680\u2003\u2028\u202f\u205f\u3000à", k=200)) for i in range(150)] + [None, "", " ", "x" * 1_000_000]
    assert [np.frombuffer(b, "<u4").tolist() for b in encode(texts)] == [ids_of(t)[:-1] for t in texts]


def test_packing_covers_all_ids(spark, docs):
    packed = packing.pack(packing.pieces(docs, tokens.public_path(), capacity=64), docs.count(), capacity=64)
    rows = packed.collect()
    spaces = {}
    for r in rows:
        assert 0 < r.length <= 64 and (r.piece == 0 or r.length == 64)
        spaces.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for s in spaces.values():
        assert [o for o, _ in sorted(s)] == [0, *itertools.accumulate(n for _, n in sorted(s))][:-1] and sum(n for _, n in s) <= 64
    for i, t in TEXTS:
        if i not in (5, None):
            mine = sorted((r.start, bytes(r.ids)) for r in rows if r.doc_id == i)
            assert np.frombuffer(b"".join(b for _, b in mine), "<u4").tolist() == ids_of(t)
    assert sum(r.length for r in rows) == sum(len(ids_of(t)) for _, t in TEXTS)
    whole = {r.sequence_id: r for r in packing.sequences(packed).collect()}
    assert all(len(r.ids) == 4 * r.length for r in whole.values())
    assert packing.pack(packing.pieces(docs.where("false"), tokens.public_path()), 0).count() == 0


def test_sum_of_squares_places_well():
    sizes = np.sort(np.random.default_rng(0).integers(1, 2049, 4000))[::-1]
    sequence, offset = packing.Placer(2048).place(sizes)
    assert sequence.max() + 1 <= 1.02 * sizes.sum() / 2048 + 1
    # each placement is the best by the definition, on a small case
    count = [0] * 33
    small = np.random.default_rng(1).integers(1, 33, 60)
    s, o = packing.Placer(32).place(small)
    for size, at in zip(small.tolist(), o.tolist(), strict=True):
        open_gaps = [g for g in range(size, 33) if count[g]]

        def cost(g, size=size):
            c = list(count)
            c[g] -= g < 32 or c[g] > 0
            c[g - size] += 1
            return sum(x * x for x in c[1:])

        gap = 32 - at
        if open_gaps:
            assert count[gap] and cost(gap) == min(map(cost, open_gaps))
            count[gap] -= 1
        count[gap - size] += gap > size


#: The automaton and the costs as the method states them, apart from the operator's own tables.
FOLLOW = {None: ("system", "user"), "system": ("user",), "user": ("assistant",), "assistant": ("user",)}


def cost_of(roles):
    """Least repair cost over every choice of empty turns before a turn, its role, and whether it is merged into the one before."""
    def with_empty(best):
        for _ in range(4):
            for a, c in list(best.items()):
                for b in FOLLOW[a]:
                    best[b] = min(best.get(b, 10**9), c + 3)
        return best

    best = {None: 0}
    for role in roles:
        ways = [(b, c + 4 * (b != role)) for a, c in with_empty(best).items() for b in FOLLOW[a]]
        ways += [(a, c + 1 + 4 * (a != role)) for a, c in best.items() if a is not None]
        best = {}
        for b, c in ways:
            best[b] = min(best.get(b, 10**9), c)
    return with_empty(best)["assistant"]


def legal(roles):
    return roles and roles[-1] == "assistant" and all(b in FOLLOW[a] for a, b in zip([None, *roles], roles, strict=False))


def test_role_repair_is_legal_and_cheapest(spark):
    cases = [["user", "assistant"], ["assistant"], ["user", "user", "assistant"], ["system", "assistant", "user"], ["tool", "user"], [None], ["user", "system", "assistant", "assistant"], ["user"] * 5, ["system", "system", "user", "assistant"]]
    r = random.Random(2)
    cases += [[r.choice(["system", "user", "assistant", "x"]) for _ in range(r.randrange(1, 30))] for _ in range(40)]
    rows = [(c, t, role, f"t{t}", 9) for c, roles in enumerate(cases) for t, role in enumerate(roles)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, place int")
    for segment in (512, 4):
        got = {}
        for x in chat.repaired(df, segment).collect():
            got.setdefault(x.conv_id, []).append(x)
        for c, roles in enumerate(cases):
            turns = sorted(got[c], key=lambda x: (x.turn, x.place))
            assert [x.old_role for x in turns] == roles
            out, total = [], 0
            for i, x in enumerate(turns):
                added = x.inserted.split(",") if x.inserted else []
                after = len(chat.closing(chat.ROLES[x.role])) if i == len(turns) - 1 else 0
                out += added[: len(added) - after]
                if not x.action.endswith("merge"):
                    out.append(x.role)
                out += added[len(added) - after :] if after else []
                total += {"keep": 0, "merge": 1, "relabel": 4, "relabel+merge": 5}[x.action] + 3 * len(added)
            assert legal(out), (roles, out)
            assert total == cost_of(roles)
            assert "".join(x.rendered for x in turns).count("<|end|>") == 1


def test_role_repair_edges(spark):
    rows = [(None, None, "user", None), (None, 0, "assistant", "b"), (1, 0, "user", "same"), (1, 0, "user", "same"), (1, 1, "assistant", "z")]
    got = chat.repaired(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect()
    assert len(got) == 5 and sorted(x.action for x in got if x.conv_id == 1) == ["keep", "keep", "merge"]
    assert chat.repaired(spark.createDataFrame([], "conv_id long, turn long, role string, text string")).count() == 0


def test_id_files_round_trip(spark, docs):
    ties = {r.text: r.h for r in docs.select("text", F.xxhash64("text").alias("h")).collect()}
    for block, group in ((idcodec.BLOCK, idcodec.GROUP), (64, 7), (1024, 2)):
        blocks = idcodec.materialise(idcodec.encoded(docs, tokens.public_path(), block=block, group=group))
        got = idcodec.catalogue(blocks).orderBy("start").collect()
        order = sorted(TEXTS, key=lambda x: (x[0] is not None, x[0] or 0, ties[x[1]], x[1] or ""))
        held = {}
        for r in sorted(idcodec.decoded(blocks).collect(), key=lambda r: (r.file, r.ordinal, r.part)):
            held[r.file, r.ordinal] = held.get((r.file, r.ordinal), b"") + bytes(r.ids)
        assert [np.frombuffer(held[k], "<u4").tolist() for k in sorted(held)] == [ids_of(t) for _, t in order]
        start = 0
        for r, (i, t) in zip(got, order, strict=True):
            raw = np.array(ids_of(t), "<u4")
            assert (r.doc_id, r.start, r.n_tokens, r.ids_crc32) == (i, start, len(raw), zlib.crc32(raw.tobytes()))
            start += len(raw)
    assert idcodec.catalogue(idcodec.materialise(idcodec.encoded(docs.where("false"), tokens.public_path()))).count() == 0


def test_codec_on_any_ids_and_damage():
    r = np.random.default_rng(4)
    blocks = [r.integers(0, top, n, dtype=np.uint32) for top, n in ((2, 500), (50_000, 300), (1, 0), (3, 1), (2**32 - 1, 90))] + [np.full(700, 11, np.uint32)]
    none = np.zeros(0, idcodec._SEGMENT)
    data = idcodec.write_blocks([(none, b) for b in blocks])
    assert all((a == b).all() for (_, a), b in zip(idcodec.read_blocks(data), blocks, strict=True))
    small = idcodec.write_blocks([(none, blocks[-1])])[0]
    assert len(small) < 200
    many = [r.integers(0, top, n, dtype=np.uint32) for top, n in ((2**32 - 1, 9000), (1000, 65_536), (5, 70_000), (50_257, 3000))]
    data_many = idcodec.write_blocks([(none, b) for b in many])
    assert all((idcodec.read_blocks([d])[0][1] == b).all() for d, b in zip(data_many, many, strict=True))  # each block alone
    skewed = (r.zipf(1.3, 100_000) % 5000).astype(np.uint32)
    share = np.bincount(skewed) / len(skewed)
    entropy = -(share[share > 0] * np.log2(share[share > 0])).sum()
    assert 8 * len(idcodec.write_blocks([(none, skewed)])[0]) < 1.12 * entropy * len(skewed)
    bad = bytearray(data[1])
    bad[60] ^= 1
    with pytest.raises(ValueError):
        idcodec.read_blocks([bytes(bad)])
    with pytest.raises(ValueError):
        idcodec.read_blocks([data[1][:-3]])


def test_revisits_equal_brute_force(spark):
    r = random.Random(1)
    urls = ["http://www.A.com/x/", "https://a.com:443/x#f", "http://a.com/x?utm_source=q", "http://a.com/y?b=1&ref=z", "http://a.com/y?b=1", None, "nourl"]
    rows = []
    for i in range(300):
        kind = r.choice(["response", "revisit"])
        headers = {k: v for k, v in (("etag", r.choice(['"1"', 'W/"1"', '"2"'])), ("last-modified", r.choice("pq")), ("date", str(i)), ("content-type", f"c{i}")) if r.random() < 0.7}
        rows.append((i, r.choice(urls), r.choice([None, *range(40)]), kind, headers, f"p{i}"))
    df = spark.createDataFrame(rows, "record_id long, url string, at long, kind string, headers map<string,string>, payload string")
    canon = {x.url: x.c for x in df.select("url", warc.canonical(F.col("url")).alias("c")).distinct().collect()}
    assert canon[urls[0]] == canon[urls[1]] == canon[urls[2]] == "a.com/x" and canon[urls[3]] == canon[urls[4]] == "a.com/y?b=1" and canon["nourl"] is None
    for slices in (64, 3):
        got = {x.record_id: x for x in warc.with_payload(warc.resolve(df, slices), df).collect()}
        assert len(got) == 300
        for i, url, at, kind, headers, payload in rows:
            c = canon[url]
            before = [x for x in rows if x[3] == "response" and c is not None and at is not None and x[2] is not None and canon[x[1]] == c and (x[2], x[0]) < (at, i)]
            state, source, merged, body = "response", i, headers, payload
            if kind == "revisit":
                state, source, body = "unresolved", None, None
                if before:
                    f = max(before, key=lambda x: (x[2], x[0]))
                    strong = lambda h: h["etag"].removeprefix("W/") if "etag" in h else None
                    ok = strong(headers) == strong(f[4]) if "etag" in headers else "last-modified" in headers and headers["last-modified"] == f[4].get("last-modified")
                    state = "resolved" if ok else "mismatch"
                    if ok:
                        source, body, merged = f[0], f[5], f[4] | {k: v for k, v in headers.items() if k in warc.PERMITTED}
            x = got[i]
            assert (x.state, x.source_id, x.headers, x.payload) == (state, source, merged, body)
    assert warc.resolve(df.where("false")).count() == 0


def test_warc_bytes_round_trip():
    made = warc.encode_record("response", {"WARC-Target-URI": "http://a/"}, b"x\r\n\r\ny") + warc.encode_record("revisit", {}, b"")
    got = list(warc.decode_records(made))
    assert [b for _, b in got] == [b"x\r\n\r\ny", b""] and got[0][0]["warc-target-uri"] == "http://a/"
    with pytest.raises(ValueError):
        list(warc.decode_records(made[:-5]))


def test_blocks_spread_over_aliases(spark):
    link = '<link rel="canonical" href="{}">'.format
    rows = [
        (1, "http://a.com/en/1", ""), (2, "http://b.org/z", link("http://a.com/en/1")), (3, "http://c.org/q?x", '<meta http-equiv="refresh" content="0; url=http://b.org/z">'),
        (4, "http://d.org/w", link("http://example.com/en/7x")), (5, "http://d.org/w2", link("/w")), (6, "http://e.com/en/3", link("http://d.org/w")), (7, None, None), (8, "nothing", link("http://a.com/en/1")), (9, "HTTP://X.Example.COM/en/7#y", None), (9, "http://f.org/", None), (10, "http://g.org/", None),
    ]
    df = spark.createDataFrame([(*r, "clash") for r in rows], "page_id long, url string, html string, verdict string")
    redirects = spark.createDataFrame([("http://f.org/", "http://c.org/q?x"), ("http://g.org/", "http://c.org/q"), (None, "x")], "from_url string, to_url string")
    got = sorted((r.page_id, r.rule, r.verdict) for r in urlfilter.url_filter(df, redirects=redirects).collect() if r.rule) + sorted((r.page_id, r.verdict) for r in urlfilter.url_filter(df, redirects=redirects).collect() if not r.rule)
    assert got == [(1, "com/en/", "block"), (6, "com/en/", "block"), (9, "example.com/en/7", "allow"), (2, "block"), (3, "block"), (4, "allow"), (5, "allow"), (7, "allow"), (8, "allow"), (9, "block"), (10, "allow")]
    assert urlfilter.url_filter(df.where("false")).count() == 0


def test_components_of_chains_stars_and_cycles(spark):
    r = random.Random(6)
    edges = [(i, i + 1) for i in range(100, 160)] + [(500, i) for i in range(600, 700)] + [(1, 2), (2, 3), (3, 1), (4, 4), (None, 5), (9, 8), (8, 9)]
    r.shuffle(edges)
    got = {x.node: x.component for x in components.components(spark.createDataFrame(edges, "src long, dst long")).collect()}
    assert got == {i: 100 for i in range(100, 161)} | {i: 500 for i in (500, *range(600, 700))} | {1: 1, 2: 1, 3: 1, 8: 8, 9: 8}


def test_pipeline_stages_by_brute_force(spark):
    import corpus_pipeline
    from flowledger.llm import ranker
    from test_text_ops import brute_components, contained

    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    bench = [(r.item_id, r.text) for r in spark.read.parquet(f"{DATA}/benchmark.parquet").collect()]
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality rules", "quality classifier", "MinHash near-dedup", "benchmark decontamination", "best-fit packing"]
    for name, stage in corpus_pipeline.STAGES:
        before = [(r.doc_id, r.text) for r in docs.collect()]
        out = corpus_pipeline.materialise(stage(spark, docs, DATA))
        if name == "best-fit packing":
            total = {}
            for r in out.collect():
                total[r.doc_id] = total.get(r.doc_id, 0) + r.length
            assert total == {i: len(ids_of(t)) for i, t in before}
            break
        assert out.columns == docs.columns
        after = {r.doc_id for r in out.collect()}
        if name == "quality classifier":
            model = ranker.fit(docs, spark.read.parquet(f"{DATA}/labels.parquet"))
            assert after == {r.doc_id for r in ranker.score(docs.select("doc_id", "text"), model).collect() if r.predicted}
        if name == "MinHash near-dedup":
            assert after == {i for i, (_, c) in brute_components(before, 5).items() if i == c}
        if name == "benchmark decontamination":
            assert after == {i for i, _ in before} - {d for d, *_ in contained(before, bench)}
        docs = out
    assert set(corpus_pipeline.run(spark, DATA).columns) >= {"doc_id", "sequence_id", "offset"}
