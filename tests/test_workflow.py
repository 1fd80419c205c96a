"""The three jobs end to end on two small registers with known links."""

import random

import pytest

from linkwright.plans import workflow
from linkwright.sources import readers

HEADER = "mention_id,source,source_year,birth_year,first_name,middle_name,norm_first_name,nysiis_last_name,norm_race,gender,confidence"
NAMES = {"F": ["MARY", "ANN", "SARAH", "LUCY", "FANNIE", "NANCY", "ELLEN", "JANE"], "M": ["JOHN", "GEORGE", "WILLIAM", "DANIEL", "ROBERT", "HENRY", "THOMAS", "PETER"]}
LAST = [f"L{i:02d}" for i in range(30)]
PEOPLE = 150


def write_registers(folder):
    rng = random.Random(17)
    people = []
    lines, kin = [HEADER], ["subject_id,object_id,predicate,who"]
    for i in range(PEOPLE):
        gender = rng.choice("FM")
        name, last, race, year = rng.choice(NAMES[gender]), rng.choice(LAST), rng.choice("BW"), rng.randrange(1800, 1868)
        other = rng.randrange(1800, 1868)
        people.append((race, gender, year))
        lines.append(f"P-1870-{i},CENSUS_1870,1870,{year}.0,{name.title()},lee,{name},{last},{race},{gender},0.9")
        kept = f"P-1880-{i},CENSUS_1880,1880,{year + rng.choice([0, 0, 0, 1, -1, 2])}.0,{name.title()},,{name},{last},{race},{gender},0.9"
        lines.append(kept)
        if i % 10 == 0:
            lines.append(kept.replace(last, "ZZZ"))  # a repeated id: the first row counts
        lines.append(f"V-{i},VITAL,1875,{other}.0,{name},,{name},{last},{race},{gender},0.9")
        if i % 3:
            kin += [f"P-1870-{i},P-1870-{i - i % 3},child_of,c70", f"P-1880-{i},P-1880-{i - i % 3},child_of,c80"]
    (folder / "mentions.csv").write_text("\n".join(lines) + "\n")
    (folder / "assertions.csv").write_text("\n".join(kin) + "\n")
    truth = ["1870_line,1880_line,score,confidence"] + [f"{i},{i},495,3" for i in range(PEOPLE)]
    # Wrong pairs that blocking lets through: same race and gender, born at most three years apart.
    for i, (race, gender, year) in enumerate(people):
        near = [j for j, p in enumerate(people) if j != i and p[:2] == (race, gender) and abs(p[2] - year) <= 3]
        truth += [f"{i},{j},75,0" for j in near[:1]]
    (folder / "ground_truth.csv").write_bytes("\r\n".join(truth).encode())


@pytest.fixture(scope="module")
def done(spark, tmp_path_factory):
    folder = tmp_path_factory.mktemp("registers")
    write_registers(folder)
    model = workflow.link(spark, str(folder / "mentions.csv"), str(folder / "predictions"), ["CENSUS_1870", "CENSUS_1880"], (1870, 1880))
    predictions = spark.read.parquet(str(folder / "predictions"))
    assertions = readers.read_assertions(spark, str(folder / "assertions.csv"))
    workflow.boost(spark, predictions, assertions, str(folder / "boosted"), str(folder / "matches"))
    boosted = readers.read_boosted(spark, str(folder / "boosted"))
    truth = readers.read_ground_truth(spark, str(folder / "ground_truth.csv"))
    return model, predictions, boosted, workflow.assess(spark, boosted, truth, ("P-1870-", "P-1880-"))


def test_known_links_are_found(done):
    _, predictions, _, measures = done
    # Last names are blocked on but not compared, so the cut that keeps candidates is the one to test.
    found = {(r[0], r[1]) for r in predictions.select("unique_id_l", "unique_id_r").collect()}
    right = {(f"P-1870-{i}", f"P-1880-{i}") for i in range(PEOPLE)}
    assert len(found & right) >= 0.9 * PEOPLE
    assert measures["metrics"].first()["auc"] > 0.8


def test_one_row_per_pair_and_only_the_two_registers(done):
    _, predictions, boosted, _ = done
    assert predictions.count() == predictions.select("unique_id_l", "unique_id_r").distinct().count() == boosted.count()
    assert predictions.filter("unique_id_l not like 'P-1870-%' or unique_id_r not like 'P-1880-%'").count() == 0
    assert predictions.filter("match_probability < 0.2").count() == 0


def test_corroboration_is_there_for_families(done):
    assert done[2].filter("relatives_match_probability is not null").count() > PEOPLE / 3


def test_every_measure_has_rows(done):
    for name, table in done[3].items():
        assert table.count() > 0, name
    assert done[3]["truth_crosstab"].columns == ["confidence", "score_75", "score_495"]
