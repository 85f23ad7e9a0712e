"""The named datasets: read from CSV or Parquet when the files exist, generated otherwise."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..functions.draws import Draws
from ..schema import NUMERICAL, RelationalSchema
from .generate import (Spec, TableSpec, choice, constant, generate_tables, integer, key, label,
                       listed, millions, phone, price_times, real, ref, scaled, spec_schema,
                       star_spec)
from .io import load_tables

# Word lists, ranges and shares of the named datasets, in natural order.
CZECH_REGIONS = ["Prague", "Central Bohemia", "South Bohemia", "West Bohemia",
                 "North Bohemia", "East Bohemia", "South Moravia", "North Moravia"]
GENRES = ["Action", "Adventure", "Animation", "Biography", "Comedy", "Crime", "Documentary",
          "Drama", "Family", "Fantasy", "History", "Horror", "Music", "Mystery", "Romance",
          "Sci-Fi", "Sport", "Thriller", "War", "Western"]
NATIONALITIES = ["American", "British", "French", "German", "Italian", "Japanese", "Korean",
                 "Indian", "Canadian", "Australian", "Spanish", "Mexican"]
ROLE_TYPES = ["lead", "supporting", "cameo", "voice", "extra"]
WORLD_REGIONS = ["AFRICA", "AMERICA", "ASIA", "EUROPE", "MIDDLE EAST"]
NATIONS = ["ALGERIA", "ARGENTINA", "BRAZIL", "CANADA", "EGYPT", "ETHIOPIA", "FRANCE", "GERMANY",
           "INDIA", "INDONESIA", "IRAN", "IRAQ", "JAPAN", "JORDAN", "KENYA", "MOROCCO",
           "MOZAMBIQUE", "PERU", "CHINA", "ROMANIA", "SAUDI ARABIA", "VIETNAM", "RUSSIA",
           "UNITED KINGDOM", "UNITED STATES"]
PART_TYPES = ["ECONOMY ANODIZED STEEL", "PROMO BURNISHED COPPER", "STANDARD POLISHED TIN",
              "LARGE BRUSHED BRASS", "MEDIUM PLATED NICKEL", "SMALL BURNISHED STEEL"]
DEPARTMENTS = ["Computer Science", "Mathematics", "Physics", "Chemistry", "Biology", "Economics",
               "History", "English", "Philosophy", "Psychology", "Electrical Engineering",
               "Mechanical Engineering", "Civil Engineering", "Statistics", "Music"]
BUILDINGS = ["Watson", "Taylor", "Painter", "Packard", "Mudd", "Gates", "Sloan", "Green", "Baker",
             "Jordan"]
RANKS = ["Assistant Professor", "Associate Professor", "Professor", "Lecturer"]
YEAR_LEVELS = ["Freshman", "Sophomore", "Junior", "Senior"]
SEMESTERS = ["2023_Fall", "2024_Spring", "2024_Fall", "2025_Spring"]
GRADES = ["A+", "A", "A-", "B+", "B", "B-", "C+", "C", "C-", "D", "F"]
GRADE_SHARES = [0.05, 0.12, 0.10, 0.12, 0.15, 0.10, 0.10, 0.10, 0.06, 0.05, 0.05]
US_REGIONS = ["Northeast", "Southeast", "Midwest", "Southwest", "West Coast", "Mountain",
              "Great Plains", "Mid-Atlantic", "Pacific Northwest", "Gulf Coast"]
STORE_TYPES = ["Supercenter", "Neighborhood Market", "Sam's Club", "Express"]
ITEM_CATEGORIES = ["Grocery", "Electronics", "Clothing", "Home & Garden", "Pharmacy", "Toys",
                   "Automotive", "Sports", "Beauty", "Office Supplies"]
BANK_DATE = (930101, 981231)

SPECS: dict[str, Spec] = {
    "berka": {
        "district": TableSpec(77, {
            "district_id": key(), "name": label("District_"), "region": choice(CZECH_REGIONS),
            "population": integer(5000, 500000), "avg_salary": integer(6000, 15000)}),
        "account": TableSpec(500, {
            "account_id": key(), "district_id": ref("district", "district_id"),
            "frequency": choice(["monthly", "weekly", "after_transaction"]),
            "date": integer(*BANK_DATE)}),
        "client": TableSpec(600, {
            "client_id": key(), "district_id": ref("district", "district_id"),
            "birth_date": integer(400101, 850101), "gender": choice(["M", "F"])}),
        "disp": TableSpec(700, {
            "disp_id": key(), "client_id": ref("client", "client_id"),
            "account_id": ref("account", "account_id"),
            "type": choice(["OWNER", "DISPONENT"], [0.75, 0.25])}),
        "order": TableSpec(400, {
            "order_id": key(), "account_id": ref("account", "account_id"),
            "amount": real(100, 50000, 2),
            "category": choice(["insurance", "loan_payment", "household", "other"])}),
        "trans": TableSpec(5000, {
            "trans_id": key(), "account_id": ref("account", "account_id"),
            "date": integer(*BANK_DATE), "type": choice(["credit", "withdrawal"]),
            "amount": real(10, 100000, 2), "balance": real(-10000, 200000, 2)}),
        "loan": TableSpec(200, {
            "loan_id": key(), "account_id": ref("account", "account_id"),
            "date": integer(*BANK_DATE), "amount": real(1000, 500000, 2),
            "duration": choice([12, 24, 36, 48, 60], role=NUMERICAL),
            "status": choice(["A", "B", "C", "D"], [0.6, 0.15, 0.15, 0.1])}),
        "card": TableSpec(150, {
            "card_id": key(), "disp_id": ref("disp", "disp_id"),
            "type": choice(["classic", "junior", "gold"], [0.6, 0.25, 0.15]),
            "issued": integer(*BANK_DATE)}),
    },
    "rossmann": {
        "store_states": TableSpec(16, {"state": key("ST_"), "state_name": label("State_")}),
        "store": TableSpec(200, {
            "store_id": key(), "store_type": choice(["a", "b", "c", "d"]),
            "assortment": choice(["a", "b", "c"]), "competition_distance": real(100, 50000, 0),
            "promo2": choice([0, 1]), "state": ref("store_states", "state")}),
        "train": TableSpec(5000, {
            "store_id": ref("store", "store_id"), "day_of_week": integer(1, 8, "categorical"),
            "sales": integer(0, 30000), "customers": integer(0, 3000),
            "open": choice([0, 1], [0.15, 0.85]), "promo": choice([0, 1], [0.4, 0.6])}),
    },
    "imdb": {
        "genre": TableSpec(20, {"genre_id": key(), "name": listed(GENRES)}),
        "director": TableSpec(300, {
            "director_id": key(), "name": label("Director_"), "nationality": choice(NATIONALITIES)}),
        "movie": TableSpec(1000, {
            "movie_id": key(), "title": label("Movie_"), "year": integer(1970, 2025),
            "rating": real(1.0, 10.0, 1), "budget": millions(0.5, 300),
            "genre_id": ref("genre", "genre_id"), "director_id": ref("director", "director_id")}),
        "actor": TableSpec(500, {
            "actor_id": key(), "name": label("Actor_"), "gender": choice(["M", "F"]),
            "birth_year": integer(1940, 2000)}),
        "cast": TableSpec(3000, {
            "cast_id": key(), "movie_id": ref("movie", "movie_id"),
            "actor_id": ref("actor", "actor_id"),
            "role_type": choice(ROLE_TYPES, [0.2, 0.35, 0.15, 0.1, 0.2])}),
    },
    "tpch": {
        "region": TableSpec(5, {
            "region_id": key(), "name": listed(WORLD_REGIONS), "comment": label("Region comment ")}),
        "nation": TableSpec(25, {
            "nation_id": key(), "name": listed(NATIONS), "region_id": ref("region", "region_id"),
            "comment": label("Nation comment ")}),
        "supplier": TableSpec(50, {
            "supplier_id": key(), "name": label("Supplier#", 4), "address": label("Addr_"),
            "nation_id": ref("nation", "nation_id"), "phone": phone(),
            "acctbal": real(-1000, 10000, 2)}),
        "part": TableSpec(100, {
            "part_id": key(), "name": label("Part_"),
            "mfgr": choice([f"Manufacturer#{i}" for i in range(1, 6)]),
            "brand": choice([f"Brand#{i}{j}" for i in range(1, 6) for j in range(1, 6)]),
            "type": choice(PART_TYPES), "size": integer(1, 50), "retail_price": real(900, 2100, 2)}),
        "partsupp": TableSpec(400, {
            "part_id": ref("part", "part_id"), "supplier_id": ref("supplier", "supplier_id"),
            "availqty": integer(1, 10000), "supplycost": real(1, 1000, 2)}),
    },
    "university": {
        "department": TableSpec(15, {
            "dept_id": key(), "name": listed(DEPARTMENTS), "building": choice(BUILDINGS),
            "budget": real(50000, 1500000, 0)}),
        "instructor": TableSpec(80, {
            "instructor_id": key(), "name": label("Prof_"), "dept_id": ref("department", "dept_id"),
            "salary": real(50000, 200000, 0), "rank": choice(RANKS, [0.3, 0.3, 0.25, 0.15])}),
        "course": TableSpec(50, {
            "course_id": key(), "title": label("Course_"), "dept_id": ref("department", "dept_id"),
            "credits": choice([1, 2, 3, 4], [0.05, 0.15, 0.55, 0.25], NUMERICAL)}),
        "student": TableSpec(200, {
            "student_id": key(), "name": label("Student_"), "dept_id": ref("department", "dept_id"),
            "gpa": real(1.5, 4.0, 2), "year_level": choice(YEAR_LEVELS, [0.3, 0.28, 0.22, 0.2])}),
        "enrollment": TableSpec(800, {
            "student_id": ref("student", "student_id"), "course_id": ref("course", "course_id"),
            "semester": choice(SEMESTERS), "grade": choice(GRADES, GRADE_SHARES)}),
    },
    "walmart": {
        "region": TableSpec(10, {
            "region_id": key(), "name": listed(US_REGIONS), "country": constant("US")}),
        "store": TableSpec(100, {
            "store_id": key(), "region_id": ref("region", "region_id"),
            "store_type": choice(STORE_TYPES, [0.5, 0.25, 0.15, 0.1]), "area": real(5000, 250000, 0)}),
        "item": TableSpec(500, {
            "item_id": key(), "item_name": label("Item_"), "category": choice(ITEM_CATEGORIES),
            "price": real(0.5, 500, 2)}),
        "sales": TableSpec(5000, {
            "store_id": ref("store", "store_id"), "item_id": ref("item", "item_id"),
            "date": integer(20230101, 20251231), "units_sold": integer(1, 50),
            "revenue": price_times("units_sold", "item", "price")}),
    },
}

STAR = "synthetic_star"


def load_dataset(spark: SparkSession, name: str, data_dir: str | None = None, fmt: str = "csv",
                 draws: Draws = Draws(), scale: float = 1.0, types=None,
                 **star) -> tuple[dict[str, DataFrame], RelationalSchema]:
    """Tables and schema of a named dataset.

    Files are used only if every table's file exists under ``data_dir/name``; ``types`` gives physical
    types of CSV tables, others are inferred.  ``scale`` multiplies
    generated row counts; keyword arguments shape the configurable star schema.
    """
    if name == STAR:
        spec = star_spec(**star)
    elif name in SPECS:
        spec = SPECS[name]
    else:
        raise ValueError(f"unknown dataset {name!r}; choose from {', '.join([*SPECS, STAR])}")
    schema = spec_schema(spec)
    if data_dir and name != STAR:
        found = load_tables(spark, schema, f"{data_dir}/{name}", fmt, types)
        if found:
            return found, schema
    return generate_tables(spark, scaled(spec, scale) if scale != 1.0 else spec, draws), schema
