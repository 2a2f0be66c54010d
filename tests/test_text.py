import html
import random
import re

from pyspark.sql import functions as F

from loamlake.functions import text as X

PIECES = [" ", "\t", "\n", "\n", "\r", "\x0b", "\x0c", "\x1c", "\x85", "\xa0", "　", " ", "a", "B", "é", "ก"]
PIECES += ["&amp;", "&nbsp;", "&ampx", "<b>", "</b>", "<", ">", "x@y.zz", "http://q.w/e ", "WWW.a", "\U0001d11e", "Σ", "_", "1"]


def py_clean(t, links=False):
    t = re.sub(r"<[^>]+>", " ", html.unescape(t))
    if links:
        t = re.sub(r"https?://\S+|www\.\S+", " ", t, flags=re.I)
        t = re.sub(r"[\w.+-]+@[\w-]+\.[\w.-]+", " ", t)
    t = re.sub(r"[ \t\r\f\v]+", " ", t)
    t = re.sub("\n{3,}", "\n\n", t)
    return "\n".join(line.strip() for line in t.split("\n")).strip()


def py_squeeze(t):
    return re.sub(r"\s+", " ", t).strip().lower()


def py_grams(t):
    s = py_squeeze(t)
    return {s[i : i + 5] for i in range(len(s) - 4)} if len(s) >= 5 else {s} - {""}


def py_share(t):
    solid = sum(not c.isspace() for c in t)
    return len(re.findall("[฀-๿]", t)) / solid if solid else 0.0


def test_text_functions_agree_with_python(spark):
    rng = random.Random(7)
    texts = ["".join(rng.choices(PIECES, k=rng.randint(0, 40))) for _ in range(1500)]
    texts += ["a \t b\n\n\n\nc\x0bd", "&nbsp;x&amp;<b>y</b>", "a\n \n \nb", ""]
    c = F.col("t")
    rows = (
        spark.createDataFrame([(t,) for t in texts], "t string")
        .select(
            "t",
            X.clean_text(c).alias("clean"),
            X.clean_text(c, strip_urls=True, strip_emails=True).alias("links"),
            X.squeeze(c).alias("squeeze"),
            X.shingles(c).alias("grams"),
            X.script_share(c).alias("share"),
            X.strip(c).alias("strip"),
        )
        .collect()
    )
    for r in rows:
        assert r.clean == py_clean(r.t)
        assert r.links == py_clean(r.t, links=True)
        assert r.squeeze == py_squeeze(r.t)
        assert set(r.grams) == py_grams(r.t) and len(r.grams) == len(set(r.grams))
        assert r.share == py_share(r.t)
        assert r.strip == r.t.strip()


def test_known_cases(spark):
    rows = spark.createDataFrame([("a\n \n \nb",), ("&nbsp;x&amp;<b>y</b>",)], "t string")
    assert [r.c for r in rows.select(X.clean_text(F.col("t")).alias("c")).collect()] == ["a\n\n\nb", "x& y"]


def test_entities_without_a_semicolon(spark):
    rows = spark.createDataFrame([("a&amp <b>b</b> &ampx; &copy;&#65;&nope;",)], "t string")
    made = [X.clean_text(F.col("t")), X.clean_text(F.col("t"), open_entities=False)]
    assert list(rows.select(*made).first()) == ["a& b &x; ©A&nope;", "a&amp b &ampx; ©A&nope;"]


def test_redaction(spark):
    row = spark.createDataFrame([("jdbc://me:secret@db.example.net/x",)], "t string")
    assert row.select(X.redact_credentials(F.col("t"))).first()[0] == "jdbc://<redacted>@db.example.net/x"
