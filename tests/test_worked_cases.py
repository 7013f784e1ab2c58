"""Worked cases of the functions over texts; the queries meet them with values of rows."""

import pytest
from pyspark.sql import functions as F

from larkspur.functions import classify, extract, money, patterns

EDUCATION = {
    "BS required, MS preferred.": ("undergraduate", None),
    "Master the team's domain.": ("", None),
    "No Master's degree is required.": ("", None),
    "Open to Bachelor's, Master's or PhD students.": ("doctoral,masters,undergraduate", None),
    "5 ms latency; BA in Physics": ("undergraduate", None),
    "Please select your degree: Masters / PhD": ("", None),
    "MBA candidates welcome": ("mba", None),
    "You must have a Bachelor's or Master's degree.": ("masters,undergraduate", "bachelors"),
    "PhD required. Publications are a plus.": ("doctoral", "doctoral"),
    "Minimum education: high school.": ("", "high-school"),
    "": ("", None),
}

HOUSING = {
    "Interns receive a housing stipend. Meals are extra.": "stipend",
    "We provide free housing; you pay for rent abroad.": "employer-paid,employee-cost",
    "Housing is not provided.": "",
    "Reasonable accommodation for interviews.": "",
    "Housing will be provided at no cost to interns not working fully remote.": "employer-paid",
    "Company accommodation is available for interns": "available",
    "Housing assistance is offered": "",
}

GRADUATION = {
    "Graduating between December 2026 and Spring 2027.": ("2026-12", "2027-05"),
    "Class of 2027 or 2028": ("2027-01", "2028-12"),
    "Graduate students may apply by May 2026.": (None, None),
    "Expected graduation June 2027. Applications close May 2026": ("2027-06", "2027-06"),
    "Degree completion in 2026; start in 2029": ("2026-01", "2026-12"),
    "No dates": (None, None),
}

BADGES = {
    "Acorn Labs 🇺🇸 | 🎓": "Acorn Labs",
    "Pine Robotics - US citizenship required": "Pine Robotics",
    "Elm; Master's degree required ; Engineer": "Elm; Engineer",
    "Oak": "Oak",
}

PAGES = {
    "This position has been filled.": True,
    "No longer available": True,
    "We are no longer accepting applications for this role": True,
    "Sorry, we're no longer accepting applications for this role": False,
    "The job expired in the test suite": False,
    "Job closed!": True,
    "Applications open": False,
}

PAY = {
    "Pay: $25 - $30 per hour.": [(25.0, 30.0, "XXX", "hourly")],
    "USD 90,000 to 120,000 per year": [(90000.0, 120000.0, "USD", "annual")],
    "The range is $90k - $120k/yr": [(90000.0, 120000.0, "XXX", "annual")],
    "£450 weekly in London; €3,000 - €3,500 monthly in Berlin": [(450.0, 450.0, "GBP", "weekly"), (3000.0, 3500.0, "EUR", "monthly")],
    "USD 20 hourly or CAD 25 hourly": [],
    "A signing bonus of USD 20,000 per year": [],
    "USD 2 - 3 per hour": [],
    "$25 per hour\nUSD $25 - $30 per hour": [(25.0, 30.0, "USD", "hourly")],
    "JPY 400,000 per month": [(400000.0, 400000.0, "JPY", "monthly")],
    "Teams of 5 per year": [],
    "": [],
}

EMPLOYERS = {"Google LLC": "faang", "Meta Inc.": "faang", "Metaview": "normal", "Notion Company, Inc.": "startup", "Sentry.io": "startup", "Weights & Biases": "startup", "Apple Bank": "normal", "": "normal"}

GRADUATION |= {
    "Graduating in 2028 for the role in Summer 2027": ("2028-01", "2028-12"),
    "The program begins in Fall 2026; graduate by Spring 2027": ("2027-05", "2027-05"),
    "Degree program starts in 2024, graduation in 2027": ("2024-01", "2027-12"),
    "Graduating in May 2028 or Spring 2029 internship 2030": ("2028-05", "2028-05"),
}
CITIZENS = {
    "US citizens only.": True, "Only United States citizens may apply": True, "You must be a U.S. citizen": True, "U.S. citizenship is required": True, "US citizens welcome": False, "Only here. US citizens": False, None: False,
}
PAY |= {
    "US$30 - US$40 per hour": [(30.0, 40.0, "USD", "hourly")],
    "Annual base salary range: $90,000 - $120,000 USD": [(90000.0, 120000.0, "USD", "annual")],
    "Hourly rate of pay: $25": [(25.0, 25.0, "XXX", "hourly")],
    "Hourly pay $25": [(25.0, 25.0, "XXX", "hourly")],
    "CAD 500 bimonthly": [(500.0, 500.0, "CAD", "other")],
}


def told(spark, cases, column):
    rows = spark.createDataFrame(list(enumerate(cases)), "n int, said string")
    return [r[0] for r in rows.orderBy("n").select(column(F.col("said"))).collect()]


@pytest.mark.parametrize(
    "cases, column",
    [
        (EDUCATION, lambda c: F.struct(F.array_join(extract.education_levels(c), ","), extract.minimum_degree(c))), (HOUSING, lambda c: F.array_join(extract.housing_kinds(c), ",")),
        (GRADUATION, lambda c: F.struct(extract.graduation_window(c)["start"], extract.graduation_window(c)["end"])), (BADGES, extract.without_badges), (PAGES, extract.closed),
        (EMPLOYERS, classify.employer_category), (CITIZENS, patterns.requires_citizenship),
    ],
)
def test_worked_cases(spark, cases, column):
    got = [tuple(x) if isinstance(x, tuple) else x for x in told(spark, cases, column)]
    assert dict(zip(cases, got)) == cases


def test_worked_pay(spark):
    got = [[tuple(x) for x in xs] for xs in told(spark, PAY, money.pay_ranges)]
    assert dict(zip(PAY, got)) == PAY
