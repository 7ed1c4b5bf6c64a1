"""Official letters, semantic chunks and element cleaning against hand-made cases."""

import duckdb
import numpy as np

from corpusloom.functions import arrow
from corpusloom.functions import letters as rules
from corpusloom.functions.dialect import DUCK
from corpusloom.operators import chunk, letters

HEAD = "CỘNG HÒA XÃ HỘI CHỦ NGHĨA VIỆT NAM\nĐộc lập - Tự do - Hạnh phúc\n"
LETTER = (
    HEAD
    + """BỘ TÀI CHÍNH
Số: 12/QĐ-BTC
Hà Nội, ngày 3 tháng 4 năm 2021
Đề tài: quản lý ngân sách

MỤC LỤC
Chương 1 ........ 3
Chương hai không có trang
Chương 3 ........ 9
Điều khoản này quy định việc sử dụng ngân sách cho các dự án của địa phương trong năm tới.
Dòng này giữ lại ........ 7
7
Trang 3/12
Điện thoại: 0123
Quyết định số: 45 ngày trước
Quét bởi máy của cơ quan
[OCR xong]
Các đơn vị báo cáo kết quả thực hiện trước ngày cuối cùng của mỗi quý theo mẫu.
Giám đốc nói chuyện với nhân viên về kế hoạch.
Kinh phí được cấp theo tiến độ của từng dự án đã được phê duyệt.
Quyết định này có hiệu lực kể từ ngày ký và thay thế các quyết định trước đây.
Phụ lục I
Nơi nhận:
- Như trên
Lưu VT
Các cơ quan khác có trách nhiệm thi hành quyết định.
KT. BỘ TRƯỞNG

Nguyễn Văn An
(kí, ghi rõ họ tên)
Trần Thị Bình"""
)
BODY = [9, 11, 12, 19, 20, 21, 22, 27]
PLAIN = "Tel: 123\n7\nMục lục\nGiám đốc nói chuyện\n\n\n\nEnd"


def clean(spark, *texts):
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string")
    return {r.doc_id: r for r in letters.clean_letters(df).collect()}


def test_body_of_a_letter(spark):
    got = clean(spark, LETTER, PLAIN, None, "", HEAD)
    lines = LETTER.split("\n")
    assert [x for x in got[0].text.split("\n") if x] == [lines[i] for i in BODY] and got[0].letter
    assert (got[1].text, got[1].letter) == (PLAIN, False)
    assert got[2].text is None and got[3].text == "" and (got[4].text, got[4].letter) == ("", True)


def test_what_is_a_letter(spark):
    yes = [
        HEAD,
        "Số: 7/CV\nTỜ TRÌNH về việc xây dựng",
        "Số: 7/CV\nHà Nội, ngày 1 tháng 2 năm 2023\nBáo cáo quý",
        "cộnghòa xã hội chủnghĩa việt nam\nđộclập - tựdo - hạnhphúc",
    ]
    no = ["", "Hội nghị bàn về nghị quyết; tình hình ngày càng phức tạp.", "Số: 7 là số may mắn", "Ngày 1 tháng 2 năm 2023 trời đẹp.\nSố: 3 cầu thủ"]
    got = clean(spark, *yes, *no)
    assert [got[i].letter for i in range(len(yes) + len(no))] == [True] * len(yes) + [False] * len(no)


def test_glued_scans_are_parted_in_any_text(spark):
    got = clean(spark, "độchính xác", HEAD + "Nội dung nghiêncứu của nhóm.")
    assert got[0].text == "độ chính xác" and got[1].text == "Nội dung nghiên cứu của nhóm."


def test_body_of_elements(spark):
    rows = [(1, i, x) for i, x in enumerate(LETTER.split("\n"))] + [(2, 0, "Tel: 12"), (2, 1, None), (3, 0, None)]
    got = letters.clean_letter_elements(spark.createDataFrame(rows, "doc_id int, i int, text string")).collect()
    assert sorted((r.doc_id, r.i) for r in got) == [*((1, i) for i in BODY), (2, 0), (2, 1), (3, 0)]


def test_rules_agree_in_both_engines(spark):
    con = duckdb.connect()
    con.execute("CREATE TABLE docs (doc_id INT, text VARCHAR)")
    con.executemany("INSERT INTO docs VALUES (?, ?)", [(0, LETTER), (1, PLAIN), (2, HEAD + PLAIN)])
    kept = con.execute(f"WITH l AS ({rules.lines_of(DUCK, 'docs')}) {rules.body(DUCK, 'SELECT * FROM l', 25)} ORDER BY 1, 2").fetchall()
    assert [i for k, i in kept if k == 0] == BODY
    assert [r[0] for r in con.execute(f"SELECT {rules.is_letter(DUCK)} FROM docs ORDER BY doc_id").fetchall()] == [True, False, True]


def test_breakpoints():
    a, b = np.array([1.0, 0, 0]), np.array([0, 1.0, 0])
    v = np.stack([a, a, a, a, b, b, b, b])
    assert [chunk.breakpoints(v, how) for how in ("fixed", "dynamic")] == [[4], [4]]
    assert 4 in chunk.breakpoints(v, "window") and chunk.breakpoints(v[:1]) == []


def test_semantic_chunks_hold_all_sentences_in_order():
    text = "Red apples grow. Red apples fall. Fast trains run. Fast trains stop. " * 3 + "End."
    for how in ("fixed", "dynamic", "window"):
        got = chunk.semantic_chunks(text, how, most_chars=40)
        assert " ".join(x["text"] for x in got) == " ".join(chunk.sentences(text)) and all(len(x["text"]) <= 40 for x in got)
    assert chunk.semantic_chunks("") == []


def test_element_text():
    assert arrow.element_text("xửlý “a”​ b-\nc ★ d", "paragraph") == 'xử lý "a" bc d'
    assert arrow.element_text("a  ★ b\n c", "table") == "a ★ b\nc"
