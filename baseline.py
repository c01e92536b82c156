"""Plain row loops over pandas frames for some of the headline queries, to hold bench.py against; prints one line of JSON.

They restate what the queries compute in the simplest way on one core, reading the same tables from $BENCH_SF_DIR.
"""

import hashlib
import json
import os
import re
import time

import pandas as pd

STOP = set("i me my we our you your he him his she her it its they them their what which who this that these those am is are was were be been being have has had do does did a an the and but if or because as until while of at by for with about against between into through during before after above below to from up down in out on off over under again further then once here there when where why how all any both each few more most other some such no nor not only own same so than too very s t can will just don should now".split())


def ngrams(text: str) -> float:
    w = re.sub(r"[^\w\s]", "", text.lower()).split()
    g = [" ".join(w[i : i + 5]) for i in range(len(w) - 4)]
    return len(set(g)) / len(g) if g else 0.0


def minhash(texts: list) -> list:
    import numpy as np
    import xxhash

    seeds = np.arange(1, 129, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    buckets, kept = {}, []
    for i, t in enumerate(texts):
        g = np.array([xxhash.xxh64_intdigest(t[j : j + 5]) for j in range(max(1, len(t) - 4))], np.uint64)
        s = ((g[None] ^ seeds[:, None]) * np.uint64(0xBF58476D1CE4E5B9)).min(1)
        keys = [(b, s[b * 8 : b * 8 + 8].tobytes()) for b in range(16)]
        near = {j for k in keys for j in buckets.get(k, ())}
        if any((s == sketch).mean() >= 0.9 for _, sketch in near and [kept[j] for j in near]):
            continue
        for k in keys:
            buckets.setdefault(k, []).append(len(kept))
        kept.append((i, s))
    return kept


def main() -> None:
    sf = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    read = lambda n: pd.read_parquet(f"{sf}/{n}.parquet")
    docs = [x or "" for x in read("documents")["text"]]
    code, pairs = read("code_input"), read("pipeline_general")
    jobs = {
        "op_word_number_filter": lambda: [len(t.split()) for t in docs if 20 <= len(t.split()) < 100_000],
        "op_ngram_score": lambda: [ngrams(t) for t in docs],
        "op_stop_word_filter": lambda: [t for t in docs if (w := t.lower().split()) and (k := sum(x in STOP for x in w)) > 2 and k / len(w) > 0.2],
        "op_hash_deduplicate": lambda: {hashlib.md5(t.encode()).hexdigest() for t in docs},
        "op_ccnet_deduplicate": lambda: {hashlib.sha1(t.encode()).hexdigest()[:16] for t in docs},
        "op_remove_stopwords_refiner": lambda: [" ".join(x for x in t.split() if x.lower() not in STOP) for t in docs],
        "op_html_url_remover_refiner": lambda: [re.sub(r"<.*?>", "", re.sub(r"https?://\S+[\r\n]*", "", t)) for t in docs],
        "op_chunks": lambda: [" ".join(w[i : i + 100]) for t in docs for w in [t.split()] for i in range(0, max(len(w) - 20, 1), 80)],
        "op_code_length": lambda: [(sum(map(len, ls)) / len(ls), max(map(len, ls))) for ls in code["lines"] if ls is not None and len(ls)],
        "op_code_base64_ratio": lambda: [sum(map(len, re.findall(r"[a-zA-Z0-9+/=\n]{64,}", t or ""))) / max(1, len(t or "")) for t in code["text"]],
        "op_bleu": lambda: [len(set((a or "").split()) & set((b or "").split())) for a, b in zip(pairs["output"], pairs["golden_answer"])],
        "op_minhash_deduplicate": lambda: minhash(docs),
    }
    took = {}
    for name, job in jobs.items():
        t = time.time()
        job()
        took[name] = round(time.time() - t, 3)
    print(json.dumps({"metric": "total_seconds", "value": round(sum(took.values()), 3), "unit": "sec", "queries": took, "sf": os.path.basename(sf.rstrip("/"))}))


if __name__ == "__main__":
    main()
