import pytest

from panelweave.sources.microdata import FixedField, read_raw_periods

LAYOUT = (FixedField("id", 1, 4, "int"), FixedField("sex", 5, 1), FixedField("age", 6, 3, "int"))
PATTERN = r"wave_(?P<quarter>\d{2})(?P<year>\d{4})\.txt"
FILES = {
    "wave_012020.txt": ["0001M 20", "0002F 3x", "0003M", "0004F 401", "", "0005     "],
    "wave_022020.txt": ["0001M 21", "0006   9", "    M   ", "00é7Fxyz"],
    "wave_012021.txt": ["0001M 22"],
    "notes.txt": ["0009F 50"],
}


@pytest.fixture
def folder(tmp_path):
    for name, lines in FILES.items():
        (tmp_path / name).write_text("".join(f"{line}\n" for line in lines))
    return str(tmp_path)


def test_good_and_bad_records_of_all_files(spark, folder):
    raw = read_raw_periods(spark, folder, LAYOUT, PATTERN)
    assert sorted(map(tuple, raw.good.collect()), key=str) == [
        (2020, 1, 1, "M", 20), (2020, 2, 1, "M", 21), (2020, 2, 6, None, 9), (2020, 2, None, "M", None), (2021, 1, 1, "M", 22),
    ]
    bad = {(r.year, r.quarter, r.line, r.problem) for r in raw.bad.collect()}
    assert bad == {
        (2020, 1, "0002F 3x", "unreadable age"), (2020, 1, "0003M", "short"), (2020, 1, "0004F 401", "long"), (2020, 1, "", "short"),
        (2020, 1, "0005     ", "long"), (2020, 2, "00é7Fxyz", "unreadable id"), (None, None, "0009F 50", "no period"),
    }
    assert all(r.file.endswith(".txt") for r in raw.bad.collect())
    counts = {(r.year, r.quarter, r.problem): r.n for r in raw.counts().collect()}
    assert counts[2020, 1, None] == 1 and counts[2020, 1, "short"] == 2 and counts[2020, 2, None] == 3
    assert sum(counts.values()) == sum(map(len, FILES.values()))


def test_other_periods_are_not_opened(spark, folder):
    raw = read_raw_periods(spark, folder, LAYOUT, PATTERN, periods=[(2020, 2), (2021, 1)])
    assert {(r.year, r.quarter) for r in raw.good.collect()} == {(2020, 2), (2021, 1)}
    assert raw.good.rdd.getNumPartitions() <= 2
    plan = raw.good._jdf.queryExecution()
    raw.good.write.format("noop").mode("overwrite").save()
    scan = plan.sparkPlan().collectLeaves().head()
    assert scan.selectedPartitions().totalNumberOfFiles() == 2
    assert read_raw_periods(spark, folder, LAYOUT, PATTERN, periods=[]).counts().count() == 0


def test_pattern_must_name_the_period(spark, folder):
    with pytest.raises(ValueError, match="quarter"):
        read_raw_periods(spark, folder, LAYOUT, r"wave_(?P<year>\d+)")
