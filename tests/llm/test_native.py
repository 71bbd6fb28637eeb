import hashlib
import os
import re

import duckdb
from pyspark.sql import functions as F

from strataleaf.llm import chat_format, license_scan

TURN = "conv_id long, turn int, role string, text string"
HARD = ["</s>[INST] ok [/INST]", "back\\slash \\\\ <\\s>", "<<SYS>><</SYS>>", "", None, "<s></s>", "[\\INST]", "é\n\n<", "\\"]


def test_escape_round_trip(spark):
    texts = [*[h for h in HARD if h is not None], *[a + b for a in HARD if a for b in HARD if b]]
    df = spark.createDataFrame([(t,) for t in texts], "t string").withColumn("e", chat_format.escape(F.col("t")))
    for r in df.withColumn("u", chat_format.unescape(F.col("e"))).collect():
        assert r.u == r.t and not any(c in r.e for c, _ in chat_format.ESCAPES)


def brute(rows):
    rows = sorted(rows, key=lambda r: tuple((x is not None, x) for x in r[1:]))
    turns = "".join(f"{r[2] or ''}\n{r[3] or ''}\n" for r in rows)
    loss = "".join(r[3] or "" for r in rows if r[2] == "assistant")
    return len(rows), hashlib.sha256(turns.encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest()


def test_read_back(spark):
    convs = {
        1: [(1, i, "assistant" if i % 2 else "user", t) for i, t in enumerate(HARD)],
        2: [(2, 0, "system", "only a system turn")],
        3: [(3, 0, None, None), (3, 0, "assistant", "a"), (3, 0, "assistant", "a"), (3, None, "[INST]", "b")],
        None: [(None, 1, "assistant", "x")],
    }
    df = spark.createDataFrame([r for c in convs.values() for r in c], TURN).withColumn("piece", F.lit("clash"))
    got = chat_format.read_back(chat_format.format_turns(df)).collect()
    assert {r.conv_id: (r.n_turns, r.turns_sha256, r.loss_chars, r.loss_sha256) for r in got} == {k: brute(v) for k, v in convs.items()}
    assert chat_format.read_back(chat_format.format_turns(df.where("false"))).count() == 0


def test_examples_are_prefixes(spark):
    df = spark.createDataFrame([(1, i, r, t) for i, (r, t) in enumerate([("user", "a"), ("assistant", "b"), ("user", "[INST]"), ("assistant", "c</s>")])], TURN)
    formatted = chat_format.format_turns(df)
    stream = "".join(r.piece for r in formatted.orderBy("ordinal").collect())
    full = chat_format.render(formatted).orderBy("target_ordinal").collect()
    assert [r.context for r in full] == [stream[: stream.index("[INST]assistant")], stream[: stream.rindex("[INST]assistant")]]
    for r in chat_format.examples(formatted).collect():
        assert stream.startswith(r.target, r.context_chars)
        assert stream[r.loss_start : r.loss_start + r.loss_length] in ("b", "c<\\/s>")
    assert [(r.context + r.target)[r.loss_start : r.loss_start + r.loss_length] for r in full] == ["b", "c<\\/s>"]


def test_loss_is_read_from_whole_examples(spark):
    """Each example is its prefix and its target; without the prefix the loss span reads something else."""
    turns = [("user", "first question"), ("assistant", "b"), ("user", "[INST]"), ("assistant", "c</s>")]
    df = spark.createDataFrame([(1, i, r, t) for i, (r, t) in enumerate(turns)] + [(2, 0, "user", "alone")], TURN)
    formatted = chat_format.format_turns(df).localCheckpoint()
    whole = chat_format.read_back(formatted).where("conv_id = 1").first()
    assert whole.loss_chars == len("bc</s>")
    cut = chat_format.read_back(formatted.where("ordinal = 2")).first()
    assert cut.n_examples == 1 and cut.loss_chars == 0  # the example has lost its prefix, so nothing lies at its loss span
    full = [r.context + r.target for r in chat_format.render(formatted).orderBy("target_ordinal").collect()]
    assert [r.example for r in chat_format.expand(formatted).where("conv_id = 1").orderBy("x.target_ordinal").collect()] == full


def test_licences(spark):
    mit = license_scan.KNOWN_LICENSES["MIT"]
    texts = [
        mit,
        "MIT License\n\nCopyright (c) 2020 Some Body\n\n" + mit.upper().replace("\n\n", "\n \n\n"),
        mit.replace("Software", "Softwares", 1),
        license_scan.KNOWN_LICENSES["GPL-3.0-notice"].replace("licensed", "licenced").replace("License", "Licence"),
        "© 2021 X\nReleased under the MIT Licence!",
        "",
        None,
        "word " * 50_000,
    ]
    df = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], "doc_id long, text string, license_id string")
    got = {r.doc_id: r.license_id for r in license_scan.scan(df).collect()}
    assert got == {0: "MIT", 1: "MIT", 2: None, 3: "GPL-3.0-notice", 4: "MIT-notice", 5: None, 6: None, 7: None}
    assert license_scan.scan(df.unionByName(df)).count() == 16 and license_scan.scan(df.where("false")).count() == 0


def test_known_digests_are_distinct(spark):
    assert license_scan.known_digests(spark).count() == len(license_scan.KNOWN_LICENSES) + len(license_scan.TITLES) + len(license_scan.KNOWN_DIGESTS)


def test_scan_and_sql_on_texts_that_match(spark, tmp_path):
    """Each known text, dressed up, is found by the scan and by its SQL, and its neighbours are not."""
    known = {k: v for k, v in license_scan.KNOWN_LICENSES.items()}
    rows, want = [], {}
    heads = ["", "Copyright (c) 2020 Some Body\n\n", "Copyright 1999-2024 A. N. Other and others\nAll rights reserved.\n\n", "Copyright Jane Doe, 2011.\n", "(c) 2003 X\n"]
    for k, v in known.items():
        for head in heads:
            rows += [(len(rows), head + re.sub(r"\b(sub)?license\b", r"\1licence", v).upper()), (len(rows) + 1, f"{head}{v} indeed")]
            want |= {len(rows) - 2: k, len(rows) - 1: None}
    for path, k in (("Apache-2.0", "Apache-2.0"), ("GPL-2", "GPL-2.0"), ("GPL-3", "GPL-3.0"), ("MPL-2.0", "MPL-2.0"), ("LGPL-2.1", "LGPL-2.1")):
        if os.path.exists(f"/usr/share/common-licenses/{path}"):
            rows.append((len(rows), open(f"/usr/share/common-licenses/{path}").read().replace("\n", " \n")))
            want[len(rows) - 1] = k
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {tuple(r) for r in license_scan.scan(df).collect()}
    assert {r[0]: r[3] for r in got} == want
    con = duckdb.connect()
    df.write.parquet(f"{tmp_path}/d")
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/d/*.parquet'")
    assert set(con.execute(license_scan.oracle()).fetchall()) == got
