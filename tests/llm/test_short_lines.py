"""Lines of any length are compared by line dedup."""

from aerolens.llm import line_dedup


def test_short_and_unspaced_lines(spark):
    han = "天地玄黄宇宙洪荒日月盈昃辰宿列张"
    rows = [
        (1, f"All rights reserved.\nLes.\n \n{han}\nsome photographs courtesy Miller\nab cd ef"),
        (2, f"All  rights reserved.\nLes.\n \n{han}\nsome photographs courtesy Smith\nab cd xy\nown"),
        (3, f"{han[:7]}人{han[8:]}\nLes\n{han[::-1]}\nภาษาไทย"),
        (4, "ภาษาไทย\nAll rights reserved."),
    ]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    out = {r.doc_id: r.text for r in line_dedup.dedup(docs).collect()}
    assert out == {1: rows[0][1], 2: " \nab cd xy\nown", 3: f"Les\n{han[::-1]}\nภาษาไทย", 4: ""}
