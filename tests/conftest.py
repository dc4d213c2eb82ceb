import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from tillage.session import local_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    session = local_session(8, 8, "tests")
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


# Two small tables made by rules. Tests compute what they expect from these rows.
TIERS = ("bronze", "silver", "gold")


def visit_rows():
    """Forty visits: one missing fee, rating and tier; the sixth visit is noted three times."""
    rows = []
    for i in range(38):
        fee = None if i == 11 else 250 * (3 + i * i % 7)
        rating = None if i == 17 else i * 13 % 41
        tier = None if i == 23 else TIERS[i * i % 3 + (i % 5 == 0)]
        rows.append((20 + i * 7 % 31, "north" if i % 4 else "south", fee, rating, tier, f"2021-{1 + i % 12:02d}-{1 + i % 27:02d}"))
    return rows + [rows[5]] * 2


def member_rows():
    """Nine members; two ages and no other are tied for the most frequent one, and one term is written NA."""
    ages = [31, 47, 36, 52, None, 47, 29, 31, 60]
    terms = [18, 40, 7, 51, 4, 3, None, 18, "NA"]
    return [(f"m{i % 8}", ages[i], TIERS[i % 3], terms[i], i % 2) for i in range(9)]


def as_csv(columns, rows):
    return "\n".join([",".join(columns), *(",".join("" if v is None else str(v) for v in r) for r in rows)]) + "\n"


VISIT_COLUMNS = ("floor", "wing", "fee", "rating", "tier", "opened")
MEMBER_COLUMNS = ("member", "age", "tier", "term", "left")


@pytest.fixture(scope="session")
def visits(spark, tmp_path_factory):
    from tillage.sources.tables import load_table

    path = tmp_path_factory.mktemp("tables") / "visits.csv"
    path.write_text(as_csv(VISIT_COLUMNS, visit_rows()))
    return load_table(spark, str(path)).cache()


@pytest.fixture(scope="session")
def members(spark, tmp_path_factory):
    from tillage.sources.tables import load_table

    path = tmp_path_factory.mktemp("tables") / "members.csv"
    path.write_text(as_csv(MEMBER_COLUMNS, member_rows()))
    return load_table(spark, str(path)).cache()
