"""Binary packing, the prefix trie and the Merkle manifest against brute force."""

import hashlib
import random
import re
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from themeloom.llm import batch_bpe, binary_packing, bpe, merkle, prefix_trie
from themeloom.llm.queries import ORACLE, QUERIES

TOKENIZER = public_tokenizers.path("word_bpe_49k.json")
TINY = "/root/testdata/sf0.001"


def alike(a, b):
    plain = lambda rows: sorted((tuple(map(str, r)) for r in rows))
    assert plain(a) == plain(b)


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(TOKENIZER)


def ids(library, text):
    return library.encode(text, add_special_tokens=False).ids


def test_batches_of_words_are_merged_as_the_library_does(library):
    coder, r = batch_bpe.BatchBpe(TOKENIZER), random.Random(3)
    bits = list("aZ Σς İ'9²\x1c\x85　&\t\n.,") + ["é", "'s", "<|endoftext|>", "ẛ̣", "🙂", "漢", "the", "ing", "tion"]
    texts = ["".join(r.choice(bits) for _ in range(r.randint(0, 60))) for _ in range(800)]
    texts += ["x" * 5000, "é" * 40, "", " ", "ha" * 24 + " " + "ha" * 25, "the " * 300]
    for text, made in zip(texts, coder.encode_all(texts), strict=True):
        assert np.frombuffer(made, "<u4").tolist() == ids(library, text), repr(text)
    plain = bpe.Bpe(TOKENIZER)
    assert coder.encode_all(texts) == [plain.encode(t) for t in texts]


def test_spellings_of_a_word_are_merged_once(library):
    coder, merged = batch_bpe.BatchBpe(TOKENIZER), []
    several = coder._several
    coder._several = lambda words: (merged.extend(words), several(words))[1]
    texts = ["Qzxjvw, qzxjvw", "QZXJVW. qzxjvw", "(qzxjvw) qzxjvw's", "<|endoftext|>Qzxjvw <|ENDOFTEXT|>", "<|endoftext|>"]
    for text in texts:
        assert np.frombuffer(coder.encode_all([text])[0], "<u4").tolist() == ids(library, text), text
    assert merged.count(b"qzxjvw") == 1
    coder.forget()
    assert [np.frombuffer(i, "<u4").tolist() for i in coder.encode_all(texts)] == [ids(library, t) for t in texts]


def test_binary_lengths():
    for total in range(1, 300):
        made = binary_packing.lengths(total, 16)
        assert sum(made) == total and made == sorted(made, reverse=True)
        assert all(n == 16 or made.count(n) == 1 for n in made) and all(n & (n - 1) == 0 for n in made)


def holds(rows, texts, library, capacity):
    """Checks of a packing: ``texts`` by id, every id once."""
    parts, placed = defaultdict(list), defaultdict(list)
    for r in rows:
        parts[r["doc_id"]].append(r)
        placed[r["sequence_id"]].append(r)
    assert sorted(placed) == list(range(len(placed)))
    for rs in placed.values():
        assert len(rs) == 1 and rs[0]["offset"] == 0 and rs[0]["length"] <= capacity and rs[0]["length"] & (rs[0]["length"] - 1) == 0
    by_number = [placed[i][0]["length"] for i in range(len(placed))]
    assert by_number == sorted(by_number, reverse=True)
    for key, text in texts.items():
        whole, at = np.array([*ids(library, text or ""), binary_packing.END_OF_TEXT], "<u4"), 0
        assert [r["length"] for r in sorted(parts[key], key=lambda r: r["start"])] == binary_packing.lengths(len(whole), capacity)
        for r in sorted(parts[key], key=lambda r: r["start"]):
            cut = whole[at:at + r["length"]]
            assert (r["start"], r["ids_crc32"], r["doc_tokens"]) == (at, zlib.crc32(cut.tobytes()), len(whole))
            at += r["length"]
        assert at == len(whole)


def test_registered_binary_packing(spark, library):
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{TINY}/documents.parquet").collect()}
    rows = QUERIES["op11_binary_packing"](spark, TINY).collect()
    holds(rows, texts, library, binary_packing.CAPACITY)
    assert {r["doc_id"] for r in rows} == set(texts)


def test_binary_packing_of_all_kinds(spark, library):
    texts = {1: "one two", 2: None, 3: "", 4: "word " * 900 + "x" * 9000, None: "of no id", 5: "same", 6: "same"}
    rows = [(i, t, 7, "mine") for i, t in texts.items()]
    df = spark.createDataFrame(rows, "doc_id long, text string, rank int, task string").repartition(3)
    holds(binary_packing.pack(df, TOKENIZER, capacity=64).collect(), texts, library, 64)
    assert binary_packing.pack(df.limit(0), TOKENIZER).collect() == []
    twice = binary_packing.pack(df.unionByName(df), TOKENIZER, capacity=64).collect()
    assert len({r["sequence_id"] for r in twice}) == len(twice)
    with pytest.raises(ValueError):
        binary_packing.pack(df, TOKENIZER, capacity=12)


def trie_of(rows):
    """Nodes by brute force, of (conv_id, turn, role, text)."""
    own={}
    for c,t,r,x in rows:
        if c is not None: own.setdefault(c,[]).append((t is not None,t or 0,r or "",x or ""))
    own={c:[(r,x) for _,_,r,x in sorted(v,key=lambda z:z[:2])] for c,v in own.items()}
    conv={}
    for c in own:
        h=zlib.crc32(str(c).encode())%4
        d=own.get(c-(abs(c)%20 if c>=0 else -(abs(c)%20)),[])
        conv[c]=tuple(d[:h]+own[c][h:])
    nodes={}
    for c,s in conv.items():
        for d in range(len(s)+1): nodes.setdefault(s[:d],[]).append(c)
    kids={}
    for p in nodes:
        if p: kids.setdefault(p[:-1],[]).append(p)
    words=lambda x: len(re.findall(r"[^\x20\x09-\x0D]+",x))
    tot={}
    for p in sorted(nodes,key=len,reverse=True):
        leaves=sum(tot[k][0] for k in kids.get(p,[])) or 1
        saved=sum(tot[k][1] for k in kids.get(p,[]))+((len(nodes[p])-1)*words(p[-1][1]) if p else 0)
        tot[p]=(leaves,saved)
    out=[]
    for p,m in nodes.items():
        e=",".join(map(str,sorted(c for c in m if conv[c]==p)))
        out.append((min(m),len(p),min(nodes[p[:-1]]) if p else None,len(m),len(kids.get(p,[])),*tot[p],hashlib.sha256(e.encode()).hexdigest()))
    return out


CONVERSATIONS = "conv_id long, turn long, role string, text string, name string, depth int"


def talk(spark, rows):
    return spark.createDataFrame([(*r, "n", 1) for r in rows], CONVERSATIONS)


def test_registered_trie(spark, db):
    rows = [tuple(r) for r in spark.read.parquet(f"{TINY}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    made = QUERIES["op12_prefix_trie"](spark, TINY)
    alike(made.collect(), trie_of(rows))
    alike(made.collect(), db.sql(ORACLE["op12_prefix_trie"]).fetchall())


def test_trie_of_few_texts_and_uneven_lengths(spark):
    r = random.Random(12)
    rows = []
    for c in r.sample(range(-45, 400), 70):
        rows += [(c, t, r.choice(["user", "bot", None]), r.choice(["a", "a b", "", None])) for t in r.sample(range(60), r.choice([0, 1, 2, 3, 9, 33]))]
    rows += [(500, t, "user", "a") for t in range(8)] + [(520, t, "user", "a") for t in range(8)]
    alike(prefix_trie.trie(talk(spark, rows).repartition(5)).collect(), trie_of(rows))


def test_trie_of_odd_rows(spark):
    long = "word " * 40_000
    rows = [(1, None, "user", "first"), (1, 0, "user", long), (1, 5, None, None), (2, None, "user", "first"), (2, 0, "user", long),
            (20, 1, "", ""), (20, 1, "", ""), (41, 0, "a", "bc"), (61, 0, "ab", "c")]
    alike(prefix_trie.trie(talk(spark, rows)).collect(), trie_of(rows))
    without = [*rows, (None, 0, "user", "first"), (None, None, None, None)]
    alike(prefix_trie.trie(talk(spark, without)).collect(), trie_of(rows))
    assert prefix_trie.trie(talk(spark, [])).collect() == []


def test_ties_do_not_depend_on_partitions(spark):
    rows = [(40, 3, "user", str(i)) for i in range(6)]
    one, other = (prefix_trie.trie(talk(spark, x).repartition(3)).collect() for x in (rows, rows[::-1]))
    alike(one, other)


def test_ids_are_hashed_in_order_across_parts(spark):
    n = 3 * prefix_trie.IDS + 5
    df = spark.range(-7, n).selectExpr("id % 2 AS k", "id AS v").repartition(6)
    made = {r["k"]: r["h"] for r in prefix_trie.ordered_digests(df, ["k"], "v", "h").collect()}
    for k in (-1, 0, 1):
        values = [v for v in range(-7, n) if (abs(v) % 2) * (-1 if v < 0 else 1) == k]
        assert made[k] == hashlib.sha256(",".join(map(str, values)).encode()).hexdigest()


def manifest_of(rows):
    """The manifest by brute force, of (doc_id, text, lang, source, n_chars)."""
    H=lambda t: hashlib.sha256(t.encode()).hexdigest()
    def f(v):
        if v is None: return b"-"
        b=str(v).encode(); return str(len(b)).encode()+b":"+b
    def leaf(r,text): return hashlib.sha256(b"".join(map(f,(r[0],r[3],r[2],r[4],text)))).hexdigest()
    low=str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ","abcdefghijklmnopqrstuvwxyz")
    trees={}
    for r in rows: trees.setdefault(r[2],[]).append(r)
    def levels(nodes):
        out=[nodes]
        while len(out[-1])>1:
            out.append([H("".join(out[-1][i:i+8])) for i in range(0,len(out[-1]),8)])
        return out
    langs=sorted(trees,key=lambda l:(l is not None,(l or "").encode()))
    built={}
    for l in langs:
        rs=sorted(trees[l],key=lambda r:(r[0] is not None,r[0] or 0,leaf(r,r[1])))
        built[l]=(rs,levels([leaf(r,r[1]) for r in rs]))
    top=levels([built[l][1][-1][0] for l in langs])
    out=[]
    for k,l in enumerate(langs):
        rs,lv=built[l]
        for i,r in enumerate(rs):
            path=[]
            for ls,at in ((lv,i),(top,k)):
                for level in ls[:-1]:
                    s=at//8*8; run=level[s:s+8]
                    path.append((run[:at-s],run[at-s+1:])); at//=8
            h=lv[0][i]
            if r[0] is not None and zlib.crc32(str(r[0]).encode())%3==0 and r[1] is not None: h=leaf(r,r[1].translate(low))
            for a,b in path: h=H("".join(a)+h+"".join(b))
            out.append((r[0],lv[0][i],lv[-1][0],top[-1][0],H("".join("".join(a)+"".join(b) for a,b in path)),h,h==top[-1][0]))
    return out


DOCUMENTS = "doc_id long, text string, lang string, source string, n_chars long, tree string, leaf int, _slab long"


def corpus(spark, rows):
    return spark.createDataFrame([(*r, "t", 1, None) for r in rows], DOCUMENTS)


def test_registered_manifest(spark, db):
    rows = [tuple(r) for r in spark.read.parquet(f"{TINY}/documents.parquet").select("doc_id", "text", "lang", "source", "n_chars").collect()]
    made = QUERIES["op13_merkle_manifest"](spark, TINY).collect()
    alike(made, manifest_of(rows))
    alike(made, db.sql(ORACLE["op13_merkle_manifest"]).fetchall())


@pytest.mark.parametrize("levels", (1, 2, 4))
def test_manifest_over_several_sweeps(spark, levels):
    rows = [(i, f"Text {i % 7} ÀB", "abc"[i % 10 // 8] if i % 31 else None, None if i % 5 else "s", i) for i in range(700)]
    rows += [(i, None if i % 2 else "X", f"lang {i % 10}", "s", None) for i in range(1000, 1010)]
    rows += [(2000 + i, "One", f"one of {i}", "s", 1) for i in range(60)]
    alike(merkle.manifest(corpus(spark, rows).repartition(4), levels=levels).collect(), manifest_of(rows))


def test_manifest_of_odd_rows(spark):
    rows = [(1, "A", "en", "s", 1), (1, "A", "en", "s", 1), (None, "B", "en", None, None), (None, None, None, None, None), (2, "", "", "", 0),
            ((1 << 60) + 1, "é😀", "en", "s", 2), ((1 << 60) + 3, "LONG " * 50_000, "en", "s", 3), (-9, "Ä A\x00", "fr", "s", 4)]
    alike(merkle.manifest(corpus(spark, rows)).collect(), manifest_of(rows))
    alike(merkle.manifest(corpus(spark, rows[:1])).collect(), manifest_of(rows[:1]))
    assert merkle.manifest(corpus(spark, [])).collect() == []


def test_changed_text_is_found(spark):
    rows = [(i, "Capital" if i % 2 else "small", "en", "s", 1) for i in range(90)]
    made = {r["doc_id"]: r["verified"] for r in merkle.manifest(corpus(spark, rows)).collect()}
    assert made == {i: not (i % 2 and zlib.crc32(str(i).encode()) % 3 == 0) for i in range(90)}
    assert not all(made.values()) and any(made.values())
