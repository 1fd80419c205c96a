"""Small random registers with missing values, near names and heavy repetition."""

import random

SCHEMA = (
    "unique_id string, norm_first_name string, nysiis_last_name string, norm_race string, gender string, birth_year int"
)
FIRST = ["JOHN", "JOAN", "JON", "ANN", "ANNA", "ALEXANDER", "MARY", "MARIA", "M", "", "WILLIAM", "WILLIS", None]
LAST = ["BRAN", "SNATH", "JANSAN", "CALAN", None]


def register(prefix, size, seed, hot=0.3):
    rng = random.Random(seed)
    rows = []
    for i in range(size):
        if rng.random() < hot:
            row = ("MARY", "BRAN", "W", "F", 1850)
        else:
            row = (
                rng.choice(FIRST),
                rng.choice(LAST),
                rng.choice(["B", "W", None]),
                rng.choice(["F", "M", "M", None]),
                rng.choice([None, *range(1838, 1862)]),
            )
        rows.append((f"{prefix}{i:04d}", *row))
    return rows


def edit_distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        previous, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            previous, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, previous + (x != y))
    return row[-1]


def gammas(left, right):
    """Levels of birth year, race, gender and first name, by definition."""
    first_l, _, race_l, gender_l, year_l = left[1:]
    first_r, _, race_r, gender_r, year_r = right[1:]

    def year():
        if year_l is None or year_r is None:
            return -1
        gap = abs(year_l - year_r)
        return 4 if gap == 0 else 3 if gap <= 1 else 2 if gap <= 2 else 1 if gap <= 5 else 0

    def same(a, b):
        return -1 if a is None or b is None else int(a == b)

    def name():
        if first_l is None or first_r is None:
            return -1
        distance = edit_distance(first_l, first_r)
        if distance <= 2:
            return 4 - distance
        return int(first_l[:1] == first_r[:1])

    return year(), same(race_l, race_r), same(gender_l, gender_r), name()


def rule_name(left, right):
    return None not in (left[1], left[2]) and (left[1], left[2]) == (right[1], right[2])


def rule_range(left, right):
    return (
        None not in (left[3], left[4], left[5], right[5])
        and (left[3], left[4]) == (right[3], right[4])
        and abs(left[5] - right[5]) <= 5
    )
