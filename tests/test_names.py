"""Names, titles, differing values and schedules on written-out cases."""

import hashlib
import random

import pytest
from pyspark.sql import functions as F

from quillspar.operators import names


@pytest.mark.parametrize(
    "kind, surface, doc, state, wanted",
    [
        ("chemical", " 液 氯", "d", None, ("液氯", "氯", "chemical::氯", "liquid", True, "dictionary", 0.95)), ("chemical", "液氯", "d", "gas", ("液氯", "氯", "chemical::氯", "gas", True, "dictionary", 0.95)),
        ("chemical", "混合气", "d", None, ("混合气", "混合气", "chemical::混合气", "gas", False, "provisional", 0.5)), ("chemical", "废液气", None, None, ("废液气", "废液气", "chemical::废液气", "liquid", False, "provisional", 0.5)),
        ("enterprise", "某某（化工）有限公司", "d", None, ("某某(化工)有限公司",) * 2 + ("enterprise::某某(化工)有限公司", None, True, "rule", 0.9)), ("enterprise", "某某", "d", None, ("某某", "某某", "enterprise::某某::d", None, False, "provisional", 0.5)),
        ("standard", "见 GB 13690-2009 第三条", "d", None, ("见GB13690-2009第三条", "GB13690-2009", "standard::GB13690-2009", None, True, "rule", 0.9)), ("standard", "某标准", None, None, ("某标准", "某标准", "standard::某标准::", None, False, "provisional", 0.5)),
        ("regulator", "某市应急管理局", "d", None, ("某市应急管理局",) * 2 + ("regulator::某市应急管理局", None, True, "rule", 0.9)), ("equipment", "液氯", "d", None, ("液氯", "液氯", "equipment::液氯::d", None, False, "provisional", 0.6)),
        ("equipment", " ", "d", None, ("", "", "", None, False, "provisional", 0.6)), ("chemical", None, "d", None, ("", "", "chemical::", None, False, "provisional", 0.5)),
    ],
)
def test_canonical_entities(spark, kind, surface, doc, state, wanted):
    chemicals = spark.createDataFrame([("液氯", "氯", "liquid"), ("液氯", "氯", "liquid")], "known string, name string, state string")
    mentions = spark.createDataFrame([(kind, surface, doc, state, 1)], "type string, surface string, doc_id string, state string, known int")
    row = names.canonical_entities(mentions, chemicals).collect()
    assert len(row) == 1 and tuple(row[0][c] for c in ("surface", "name", "entity_id", "physical_state", "resolved", "level", "confidence")) == wanted


def test_core_titles(spark):
    cases = {
        "20240131--关于印发《危险化学品（试行）目录》的通知.pdf": "危险化学品目录", "GB 13690—2009_化学品分类 和 标签.PDF": "化学品分类和标签", "GB/T 1-2009_x": "GBT12009x", "关于公布〔2011〕95号〈办法〉的规定": "号办法".replace("号", "95号"),
        "A_b-c/d·e\\f 的公告-20230102": "Abcdef", "标题.20230102": "标题", "": "", "的通知": "", "AQ 3011-2007": "",
    }
    frame = spark.createDataFrame([(t,) for t in [*cases, None]], "t string")
    assert [r[0] for r in frame.select(names.core_title(F.col("t"))).collect()] == [*cases.values(), ""]


def test_numbers_that_differ(spark):
    rows = [(k, "s", f"at {k % 2 + 3}.5 ℃ and 7 MPa") for k in range(30)] + [(99, "t", "3 ℃, 3 ℃, 4℃ 5"), (98, "u", None), (97, "u", "1 ppm")]
    found = names.numeric_conflicts(spark.createDataFrame(rows, "page int, section string, content string")).collect()
    got = {(r.section, r.unit): [(v.value, v.pages) for v in r["values"]] for r in found}
    assert got == {("s", "℃"): [("3.5", [*range(0, 16, 2)]), ("4.5", [*range(1, 17, 2)])], ("t", "℃"): [("3", [99]), ("4", [99])]}


def test_schedule(spark):
    rnd = random.Random(2)
    rows = [(d, n, "x") for d in range(40) for n in rnd.sample(range(100), rnd.randrange(1, 9))]
    rnd.shuffle(rows)
    frame = spark.createDataFrame(rows, "d int, n int, place string").drop("place").repartition(5)
    got = {(r.d, r.n): (r.round, r.place) for r in names.schedule(frame, "d", "n").collect()}
    rounds = {(d, n): sorted(m for e, m, _ in rows if e == d).index(n) + 1 for d, n, _ in rows}
    order = sorted(rounds, key=lambda k: (rounds[k], hashlib.sha1(str(k[0]).encode()).hexdigest()))
    assert got == {k: (rounds[k], place) for place, k in enumerate(order, 1)}
    assert names.schedule(frame.limit(0), "d", "n").count() == 0
