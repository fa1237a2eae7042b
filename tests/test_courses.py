import random

import pytest
from pyspark.sql import functions as F

from lectern.operators import courses as co
from lectern.operators.scan import carry_with_reset, running

HEADER = ["T T", "Mã số", "Tên học phần"] + [""] * 7
TEXT_ROWS = [
    HEADER,
    ["Khối kiến thức X"] * 10,
    ["1", "AB 101", "Một (*)", "3", "3", "", "30", "", "", ""],
    ["2", "AB102, AB103", "Hai", "3", "AV", "10 AV\nhoặc PV", "", "", "AB101", ""],
    HEADER,
    ["3", "AB104", "Ba", "3", "", "", "", "", "", "AB101"],
    ["4", "AB105", "Bốn", "3", "PV", "", "", "", "", ""],
    ["5", "AB106", "Năm", "3", "", "6 TC", "", "", "", ""],
    ["6", "AB107", "Sáu", "3", "2", "", "", "", "", ""],
    ["Tổng cộng: 99 TC", "", "", "", "", "", "", "", "", ""],
    ["Cộng: 20 TC (Bắt buộc 12 TC; Tự chọn: 8 TC)", "", "", "", "", "", "", "", "", ""],
    ["7", "AB108", "Bảy", "3", "XY", "", "", "", "", ""],
]


def frame(spark, rows, doc="d"):
    return spark.createDataFrame(
        [(doc, i, r) for i, r in enumerate(rows)], "doc_id string, row_no bigint, cells array<string>"
    )


@pytest.mark.parametrize("chunk_rows", [1, 3, 1000])
def test_states_do_not_depend_on_chunks(spark, chunk_rows):
    states = co.course_states(co.clean_rows(frame(spark, TEXT_ROWS)), chunk_rows)
    got = {r.row_no: (r.block, r.requirement, r.subgroup) for r in states.collect()}
    block = "Khối kiến thức X"
    assert got == {
        1: (block, None, None),
        2: (block, None, None),
        3: (block, "10 AV hoặc PV", "AV"),
        5: (block, "10 AV hoặc PV", "AV"),
        6: (block, "10 AV hoặc PV", "PV"),
        7: (block, "6 TC", "PV"),
        8: (block, None, None),
        9: (block, None, None),
        10: (block, None, None),
        11: (block, None, None),
    }


def test_nodes_and_edges(spark):
    programmes = spark.createDataFrame([("d", "P", "N (M)", "Đại trà")], "doc_id string, program_id string, ten_nganh string, loai_hinh string")
    table = co.with_ids(co.course_states(co.clean_rows(frame(spark, TEXT_ROWS))), programmes)
    nodes = {(r.label, r.id): r for r in co.course_nodes(table).collect()}
    block = nodes["KhoiKienThuc", "P_KHOI_KIEN_THUC_X"]
    assert (block.props["tong_tin_chi"], block.props["tin_chi_bat_buoc"], block.props["tin_chi_tu_chon"]) == ("20", "12", "8")
    assert block.text.endswith("tổng cộng: 20 tín chỉ.")
    assert nodes["HocPhan", "AB101"].props["bat_buoc"] == "true"
    assert nodes["HocPhan", "AB103"].props["bat_buoc"] == "false"
    edges = {(r.source, r.type, r.target) for r in co.course_edges(table).collect()}
    req = "P_KHOI_KIEN_THUC_X_REQ_10_AV_HOAC_PV"
    assert (f"{req}_SUB_PV", "GOM_HOC_PHAN", "AB105") in edges
    # the subgroup outlives the requirement it was opened under
    assert (f"{req}_SUB_PV", "GOM_HOC_PHAN", "AB106") in edges
    assert ("AB102", "YEU_CAU_TIEN_QUYET", "AB101") in edges and ("AB103", "YEU_CAU_TIEN_QUYET", "AB101") in edges
    assert ("P_KHOI_KIEN_THUC_X", "GOM_HOC_PHAN", "AB107") in edges


def walk(rows):
    """The same rules one row after the other."""
    block = req = sub = under = None
    out = {}
    for i, (kind, comp, elec) in enumerate(rows):
        if kind == "b":
            block, req, sub, under = f"K{i}", None, None, None
        elif kind == "t":
            req = sub = under = None
        else:
            if comp.isdigit():
                req = sub = under = None
            if elec:
                req = elec
            if comp and not comp.isdigit() and req:
                sub, under = comp, req
        out[i] = (block, req, sub, under)
    return out


def test_states_match_a_walk_on_random_tables(spark):
    rng = random.Random(5)
    rows, want = [], {}
    for doc in range(30):
        plain = [
            (rng.choice("bt" + "c" * 6), rng.choice(["", "", "3", "AV", "PV"]), rng.choice(["", "", "", "10 A", "6 B"]))
            for _ in range(40)
        ]
        for i, state in walk(plain).items():
            want[str(doc), i] = state
        for i, (kind, comp, elec) in enumerate(plain):
            first = f"BLOCK_HEADER:K{i}" if kind == "b" else "Cộng" if kind == "t" else "1"
            rows.append((str(doc), i, [first, "", "", "", comp if kind == "c" else "", elec if kind == "c" else "", "", "", "", ""]))
    df = spark.createDataFrame(rows, "doc_id string, row_no bigint, cells array<string>")
    for chunk_rows in (7, 1000):
        got = {
            (r.doc_id, r.row_no): (r.block, r.requirement, r.subgroup, r.subgroup_under)
            for r in co.course_states(df, chunk_rows).collect()
        }
        assert got == want


def test_running_values_of_a_hot_key(spark):
    rng = random.Random(3)
    rows = [("hot" if rng.random() < 0.5 else f"k{rng.randrange(5)}", i, rng.choice(["set", "reset", "none"]), rng.randrange(9)) for i in range(600)]
    want, state, total = {}, {}, {}
    for key, i, kind, value in rows:
        state[key] = value if kind == "set" else None if kind == "reset" else state.get(key)
        total[key] = total.get(key, 0) + value
        want[i] = (total[key], state[key])
    df = spark.createDataFrame(rows, "k string, seq bigint, kind string, v int").repartition(4)
    kind = F.col("kind")
    for chunk_rows in (10, 64, 10_000):
        got = running(
            df, ["k"], "seq", sums={"total": F.col("v")},
            lasts={"s": carry_with_reset(F.col("v"), kind == "set", kind == "reset")}, chunk_rows=chunk_rows,
        )
        assert {r.seq: (r.total, r.s["value"] if r.s else None) for r in got.collect()} == want


def test_rows_are_dealt_before_they_become_many_nodes(spark):
    codes = ", ".join(f"AA{i:03d}" for i in range(1, 71))
    rows = spark.createDataFrame(
        [(d, 1, ["1", codes, "một", "3", "3", "", "30", "", "", ""]) for d in range(20)], "doc_id long, row_no long, cells array<string>")
    programmes = rows.selectExpr("doc_id", "'P' program_id", "'N' ten_nganh", "'L' loai_hinh")
    nodes = co.course_nodes(co.with_ids(co.course_states(co.clean_rows(rows)), programmes))
    assert "RepartitionByExpression" in nodes._jdf.queryExecution().optimizedPlan().toString()
    assert nodes.where("label = 'HocPhan'").count() == 20 * 70


def test_cells_are_cleaned_once(spark):
    rows = spark.createDataFrame([("d", 1, [" a\nb", "Mã số"]), ("d", 2, [" a\nb", None])], "doc_id string, row_no bigint, cells array<string>")
    cleaned = co.clean_rows(rows)
    assert cleaned._jdf.queryExecution().optimizedPlan().toString().count("replace(") == 1
    assert [tuple(r) for r in cleaned.collect()] == [("d", 2, ["a b", ""])]
