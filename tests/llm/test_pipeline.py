import hashlib
import random
from collections import Counter, defaultdict

import tiktoken

import corpus_pipeline
from tallyframe.llm import bpe, mixing
from tests.llm.test_simhash import by_definition, components

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def corpus(spark):
    rng = random.Random(11)
    words = {"xx": [f"{a}{b}o" for a in "kltmb" for b in "aeiou"], "yy": [f"{a}{b}ck" for a in "strwn" for b in "ueiao"]}
    rows = []
    for i in range(150):
        lang = rng.choice(["xx", "yy"])
        lines = [" ".join(rng.choices(words[lang], k=rng.randrange(3, 25))) for _ in range(rng.randrange(1, 6))]
        if rng.random() < 0.4:
            lines.insert(rng.randrange(len(lines) + 1), "kabo lobo tabo shared by all")
        rows.append([i, "\n".join(lines), lang, f"s{rng.randrange(8)}"])
    rows += [[200 + i, rows[5][1], rows[5][2], f"s{i}"] for i in range(4)]
    rows += [[300, "123 456 789", "xx", "s1"], [301, None, "yy", "s1"], [302, "", None, None]]
    return [(i, t, lang, s, len(t or "")) for i, t, lang, s in rows], spark.createDataFrame([(i, t, lang, s, len(t or "")) for i, t, lang, s in rows], SCHEMA)


def brute_force(rows):
    rows = [r for r in rows if any(c.isalpha() for c in r[1] or "")]
    sites, first = defaultdict(set), {}
    for i, t, _, s, _ in rows:
        for k, line in enumerate(t.split("\n")):
            if len(line.split()) >= 3:
                sites[line].add(s)
                first[line] = min(first.get(line, (i, k)), (i, k))
    common = {x for x, s in sites.items() if len(s) >= 5}
    rows = [(i, "\n".join(x for k, x in enumerate(t.split("\n")) if x not in common or first[x] == (i, k)), lang, s) for i, t, lang, s, _ in rows]
    rows.sort(key=lambda r: r[0])
    root = components([by_definition(r[1]) for r in rows])
    return [(*r, len(r[1])) for k, r in enumerate(rows) if root[k] == k]


def test_stages_and_run(spark, tmp_path):
    rows, docs = corpus(spark)
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    now, seen = docs, []
    for name, stage in corpus_pipeline.STAGES[:4]:
        now = stage(spark, now, str(tmp_path))
        assert now.columns == docs.columns and [t for _, t in now.dtypes] == [t for _, t in docs.dtypes], name
        now = spark.createDataFrame(now.collect(), now.schema)
        seen.append(sorted(map(tuple, now.collect()), key=str))
    expected = brute_force(rows)
    assert sorted(expected, key=str) == seen[2]
    plan = {r["doc_id"]: r["copies"] for r in mixing.mix(spark.createDataFrame(expected, SCHEMA)).collect()}
    assert Counter(r[0] for r in seen[3]) == Counter({i: n for i, n in plan.items() if n})
    ranks = bpe.read_ranks(open(bpe.default_vocabulary()[0], "rb").read())
    coder = tiktoken.Encoding("own", pat_str=bpe.default_vocabulary()[1], mergeable_ranks=ranks, special_tokens={})
    sha = lambda x: hashlib.sha256(x).hexdigest()
    final = sorted((i, len(ids := coder.encode_ordinary(t)), sha(",".join(map(str, ids)).encode()), sha(t.encode())) for i, t, *_ in seen[3])
    assert sorted(map(tuple, corpus_pipeline.run(spark, str(tmp_path)).collect())) == final


def test_empty_corpus(spark, tmp_path):
    spark.createDataFrame([], SCHEMA).write.parquet(str(tmp_path / "documents.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_extra_columns_repeated_ids_and_long_texts(spark, tmp_path):
    """Columns of the names that stages use themselves go through unchanged; a text of a megabyte and repeated rows too."""
    rng = random.Random(12)
    words = [f"{a}{b}{c}" for a in "klmt" for b in "aeo" for c in "nrs"]
    text = lambda n: " ".join(rng.choices(words, k=n))
    rows = [(i, f"{text(40)}\nkan lor mes shared by all", "xx", f"s{i % 6}") for i in range(30)]
    rows += [(40, text(250_000), "xx", "s1"), (5, text(60), "xx", "s2"), (5, rows[5][1], "xx", "s5"), (None, text(50), None, None)]
    extra = "score double, lang_pred string, n_lines long, n_removed long, gain double, `a.b` string, row int, key string, th long, source_size long, rank long"
    own = (777.0, "mine", 777, 778, 779.0, "ab", 1, "k", 2, 3, 4)
    docs = spark.createDataFrame([(i, t, lang, s, len(t), *own) for i, t, lang, s in rows], f"{SCHEMA}, {extra}")
    now = docs
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES[:4]):
        stage(spark, now, "").write.parquet(f"{tmp_path}/{k}")
        now = spark.read.parquet(f"{tmp_path}/{k}")
        assert now.columns == docs.columns, name
        assert {tuple(r)[5:] for r in now.collect()} == {own}, name
    found = spark.read.parquet(f"{tmp_path}/2").collect()
    assert sorted((r["doc_id"] for r in found), key=str) == sorted([*range(30), 40, 5, None], key=str)
    assert {r["n_chars"] == len(r["text"]) for r in found} == {True} and max(r["n_chars"] for r in found) == len(rows[30][1])
    out = corpus_pipeline.byte_bpe(spark, now, "")
    assert out.columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"] and out.count() == now.count()


def test_scratch_folder_is_the_clusters():
    from types import SimpleNamespace

    from tallyframe.llm.common import scratch_dir, scratch_path

    session = SimpleNamespace(conf=SimpleNamespace(get=lambda key, default: {"spark.checkpoint.dir": "hdfs://shared/x/"}.get(key, default)))
    assert scratch_dir(session) == "hdfs://shared/x"
    assert scratch_path(session, "a").startswith("hdfs://shared/x/tallyframe/a-")
