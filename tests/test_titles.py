import pytest
from pyspark.sql import functions as F

from panelweave.operators import text

# title, exchange, star, st, kind
CASES = [
    ("关于公司股票实施退市风险警示的公告", "SSE", "set", None, "change"),
    ("[临时公告]关于撤销“退市风险警示”的公告", "BSE", "revoke", "revoke_implied", "change"),
    ("关于公司股票撤销退市风险警示并继续实施其他风险警示的公告", "SZSE", "revoke", "assert", "change"),
    ("关于撤销部分其他风险警示的公告", "SSE", None, None, "ignore"),
    ("关于继续实施其他退市风险警示的公告", "SSE", None, "assert", "assert"),
    ("关于股票将被实施退市风险警示的第二次提示性公告", "SSE", None, None, "ignore"),
    ("关于股票将被实施退市风险警示的第二次提示性公告", "BSE", "set", None, "change"),
    ("关于股票将被实施退市风险警示暨停牌的提示性公告", "SSE", "set", None, "change"),
    ("关于股票可能被实施退市风险警示的公告", "SSE", None, None, "ignore"),
    ("关于撤销风险警示的公告", "SSE", "revoke", "revoke", "change"),
    ("关于撤销因重整而被实施的退市风险警示及继续实施退市风险警示的公告", "SSE", "assert", None, "assert"),
    ("关于实施其他风险的公告", "SSE", None, "set", "change"),
    ("关于股票交易撤销其他风险警示、叠加退市风险警示的公告", "SSE", "set", "revoke", "change"),
    ("关于日常经营合同的公告", "SSE", None, None, "ignore"),
    ("关于 实施 风险风险警示 的公告", "SSE", None, None, "ignore"),
    (None, "SSE", None, None, "ignore"), ("", "SSE", None, None, "ignore")]


@pytest.mark.parametrize("chunk", [CASES])
def test_titles(spark, chunk):
    df = spark.createDataFrame([(i, *c[:2]) for i, c in enumerate(chunk)], "i int, title string, exchange string")
    got = {r["i"]: (r["c"]["star"], r["c"]["st"], r["c"]["kind"]) for r in df.withColumn("c", text.classify_title(F.col("title"), F.col("exchange"))).collect()}
    for i, case in enumerate(chunk):
        assert got[i] == case[2:], case
