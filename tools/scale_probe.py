"""Growth check: the flagship packer and length statistics on k copies of
the documents table (distinct keys per copy), for k = 1, 2, 4, ...

    python tools/scale_probe.py /root/testdata/sf0.1 1 2 4

Prints one JSON line per k: rows, characters, seconds and characters/s.
Near-constant characters/s means the plan grows linearly with the data.
"""

from __future__ import annotations

import json
import os
import sys
import time

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)


def main() -> None:
    sf = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.1"
    ks = [int(x) for x in sys.argv[2:]] or [1, 2, 4]
    from pyspark.sql import functions as F

    from tokenmill.functions import tokens as T
    from tokenmill.operators import metrics as M
    from tokenmill.operators.packing import pack_chars
    from tokenmill.session import get_session, table

    spark = get_session("local[8]", 8, extra={"spark.driver.memory": "16g"})
    docs = table(spark, sf, "documents").select("doc_id", "text")
    pack_chars(docs, "text", ["doc_id"], 64, 2, 3).write.format("noop").mode("overwrite").save()  # warm-up
    for k in ks:
        copy = F.explode(F.sequence(F.lit(0).cast("long"), F.lit(k - 1).cast("long")))
        big = docs.select("doc_id", "text", copy.alias("copy")) \
            .select((F.col("doc_id") * k + F.col("copy")).alias("doc_id"), "text")
        n_chars = big.agg(F.sum(F.char_length("text"))).first()[0]
        t0 = time.time()
        pack_chars(big, "text", ["doc_id"], 64, 2, 3).write.format("noop").mode("overwrite").save()
        t_pack = time.time() - t0
        t0 = time.time()
        row, hist = M.length_stats(big.select((T.char_count("text") + 1).alias("n")), "n")
        hist.collect()
        t_stats = time.time() - t0
        print(json.dumps({"k": k, "rows": big.count(), "chars": int(n_chars),
                          "pack_sec": round(t_pack, 2), "pack_chars_per_sec": round(n_chars / t_pack),
                          "stats_sec": round(t_stats, 2)}), flush=True)


if __name__ == "__main__":
    main()
