"""Report lines read by the rules of functions/rules, once for each order.

An order's key picks one of the stated forms of line; the rule reads every order's line, and what it reads is counted.
one, and the SQL counts orders by the stated values."""

from __future__ import annotations

from pyspark.sql import functions as F

from quern.functions import rules as R
from quern.functions import text as T
from quern.operators import finance as fin
from quern.registry import register
from quern.sources.tables import table

SQL_TYPES = {"string": "VARCHAR", "bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "boolean": "BOOLEAN"}
#: name: (given columns, expected columns, cases, rule)
CASES: dict[str, tuple] = {}


def columns(of: str) -> list[tuple[str, str]]:
    return [tuple(x.split()) for x in of.split(", ")]


def counted(given: str, expected: str, cases: list[tuple]) -> str:
    """SQL that counts orders by what is stated for the form that each has; a form may give several rows or none."""
    names, n = columns(given + ", " + expected), len(columns(given))
    forms = list(dict.fromkeys(c[:n] for c in cases))

    def one(value, kind: str) -> str:
        if value is None:
            return f"CAST(NULL AS {SQL_TYPES[kind]})"
        text = value.replace("'", "''") if isinstance(value, str) else str(value).lower() if isinstance(value, bool) else str(value)
        return f"CAST('{text}' AS {SQL_TYPES[kind]})"

    made = ", ".join("(" + ", ".join([str(forms.index(c[:n])), *[one(v, kind) for v, (_, kind) in zip(c, names, strict=True)]]) + ")" for c in cases)
    own = ", ".join(f'"{c}"' for c, _ in names)
    return f"SELECT {own}, count(*) AS orders, CAST(sum(o_orderkey) AS BIGINT) AS keys FROM orders JOIN (VALUES {made}) t(form, {own}) ON form = o_orderkey % {len(forms)} GROUP BY ALL"


def literal(name: str, given: str, expected: str, cases: list[tuple], make) -> None:
    """Registers a query over the orders' lines. given, expected: columns as 'name type, ...'; a case is the given
    values, then the expected ones; make: the expected columns from the given ones, beside o_orderkey."""
    names, n = columns(given + ", " + expected), len(columns(given))
    forms = list(dict.fromkeys(c[:n] for c in cases))
    CASES[name] = (given, expected, cases, make)

    def query(spark, d):
        kinds = columns(given)
        row = lambda f: F.struct(*[F.lit(v).cast(kind).alias(c) for v, (c, kind) in zip(f, kinds, strict=True)])
        lines = table(spark, d, "orders").select("o_orderkey", F.element_at(F.array(*map(row, forms)), (F.pmod("o_orderkey", F.lit(len(forms))) + 1).cast("int")).alias("line")).select("o_orderkey", "line.*")
        read = make(lines, "o_orderkey").select("o_orderkey", *[F.col(x).cast(kind).alias(x) for x, kind in names])
        return read.groupBy(*[x for x, _ in names]).agg(F.count(F.lit(1)).alias("orders"), F.sum("o_orderkey").alias("keys"))

    query.__name__ = name
    register(name, counted(given, expected, cases))(query)


literal(
    "heading_families", "heading string", "family string, confidence double, method string",
    [
        ("Activity Progress Narrative:", "narrative", 0.95, "exact"), ("Benefit Type", "metadata", 0.95, "exact"), ("Housing Type", "metadata", 0.9, "suffix_type"), ("Grant Award Amount", "finance", 0.85, "regex_finance"),
        ("  TOTAL : ", "finance", 0.95, "exact"), ("Projected Start Date", "timeline", 0.9, "regex_timeline"), ("Community Development Systems", "boilerplate", 0.95, "substring"), ("# of Housing Units", "metrics", 0.85, "regex_metrics"),
        ("Overall  Damage", "narrative", 0.8, "regex_narrative"), ("Census Tract", "metadata", 0.65, "regex_metadata"), ("Hello", "other", 0.3, "fallback"), ("   ", "other", 0.1, "empty"), (None, "other", 0.1, "empty"),
    ],
    lambda df, *keep: df.select(*keep, "heading", R.heading_family(F.col("heading")).alias("x")).select(*keep, "heading", "x.*"),
)

literal(
    "activity_types", "raw string", "type string, is_buyout boolean, type_group string",
    [
        ("Acquisition - general", "Acquisition/Buyout", True, "Acquisition/Buyout"), ("Public  services", "Public Services", False, "Infrastructure"), ("AFFORDABLE RENTAL HOUSING (KRW)", "Affordable Rental", False, "Housing"),
        ("Some buyout thing", "Acquisition/Buyout", True, "Acquisition/Buyout"), ("Rehab of roofs", "Rehabilitation/Reconstruction", False, "Other"), ("new school construction", "New Construction", False, "Other"),
        ("State Admin", "Administration", False, "Administration"), ("Clearance and Demolition", "Other", False, "Other"), ("Street improvements", "Infrastructure", False, "Infrastructure"), (None, "Other", False, "Unknown"),
    ],
    lambda df, *keep: df.select(*keep, "raw", R.activity_type(F.col("raw")).alias("x"), R.type_group(F.col("raw")).alias("type_group")).select(*keep, "raw", "x.*", "type_group"),
)

literal(
    "housing_types", "text string", "housing_type string",
    [("Single family homes", "Single-family"), ("120 apartment units", "Multifamily"), ("Homeowner and rental repair", "Mixed"), ("SF only", "Single-family"), ("SF", "N/A"), ("drainage", "N/A"), (None, "N/A")],
    lambda df, *keep: df.select(*keep, "text", R.housing_type(F.col("text")).alias("housing_type")),
)

literal(
    "activity_fields", "text string", "known string, benefit string, objective string, status string",
    [
        ("Responsible Organization: $0.00 Texas GLO Affordable Rental Housing Under Way", "Affordable Rental Housing", None, None, "Under Way"),
        ("Activity Status: Completed\nBenefit Type: Direct ( HouseHold )\nNational Objective: Low/Mod\nProgram", None, "Direct ( HouseHold )", "Low/Mod", "Completed"),
        ("Activity Status: Canceled Total", None, None, None, "Cancelled"), ("Benefit Type: Overall $1,000.00 Area Benefit\nNational Objective: Urgent Need Activity", None, "Area Benefit", "Urgent Need", None), ("nothing", None, None, None, None),
    ],
    lambda df, *keep: df.select(*keep, "text", R.known_type(F.col("text")).alias("known"), R.benefit_type(F.col("text")).alias("benefit"), R.national_objective(F.col("text")).alias("objective"), R.activity_status(F.col("text")).alias("status")),
)

literal(
    "status_lines", "text string", "status string, type string",
    [
        ("Activity Type:\nAdministration\n$ 1,000.00\nUnder Way\nCompleted", "Under Way", "Administration"), ("Completed", "Completed", None), ("n/a\nHousing repair\nTitle:\n  Cancelled  ", "Cancelled", "Housing repair"),
        ("It was Completed then", None, None), ("", None, None),
    ],
    lambda df, *keep: df.select(*keep, "text", R.status_and_type(F.col("text")).alias("x")).select(*keep, "text", "x.*"),
)

literal(
    "status_names", "status string", "name string",
    [("completed ", "Completed"), ("Underway", "Under Way"), ("CANCELLED by grantee", "Cancelled"), ("Not  started", "Not Started"), ("On hold", "On hold"), ("", None), (None, None)],
    lambda df, *keep: df.select(*keep, "status", R.status_name(F.col("status")).alias("name")),
)

literal(
    "counties_of_codes", "code string", "county string",
    [("HRP_HarrisCounty_01", "Harris County"), ("INF_FortBendCounty", "FortBend"), ("HAP_Houston", None)],
    lambda df, *keep: df.select(*keep, "code", R.county_of_code(F.col("code")).alias("county")),
)

literal(
    "beneficiary_lines", "line string", "this_period bigint, low bigint, mod bigint, total bigint, expected bigint, measure string, lmi_percent double",
    [
        ("0 263/0 17/281 280/281 # of Households 0 0 100.00", 0, 263, 17, 280, 281, "Households", 100.0), ("6 0/0 198/626 198/626 # Renter 0 6 100.00", 6, 0, 198, 198, 626, "Renter", 100.0),
        ("# of Persons 12/40", None, None, None, 12, 40, "Persons", None), ("no numbers", None, None, None, None, None, None, None),
    ],
    lambda df, *keep: df.select(*keep, "line", R.beneficiary_line(F.col("line")).alias("x")).select(*keep, "line", "x.*"),
)

_PAGE = "LMI%: 51.5\nLow/Mod 3 1/2 3/4 5/6 # of Owner Households 0 1 99.5\nLow/Mod 2.5 0/0 7/9 7/9 # of Widgets 0 0 0"
literal(
    "beneficiary_measures", "text string", "measure_raw string, measure string, canonical_measure string, this_period double, low_actual bigint, mod_expected bigint, total_actual bigint, total_expected bigint, lmi double",
    [(_PAGE, "Owner Households", "owner_households", "owner_households", 3.0, 1, 4, 5, 6, 51.5), (_PAGE, "Widgets", "widgets", None, 2.5, 0, 9, 7, 9, 51.5)],
    lambda df, *keep: df.select(*keep, "text", R.lmi_percent(F.col("text")).alias("lmi"), F.inline(R.beneficiary_rows(F.col("text")))),
)

_DONE = "Accomplishments Performance Measures\n280/281 # of Housing Units 0\n86/98 # of Elevated  Structures 0\nBeneficiaries Performance Measures\n1/2 # of Plans"
literal(
    "accomplishment_measures", "text string", "measure string, actual bigint, expected bigint", [(_DONE, "Housing Units", 280, 281), (_DONE, "Elevated Structures", 86, 98)],
    lambda df, *keep: df.select(*keep, "text", F.inline(R.accomplishments(F.col("text")))),
)

literal(
    "organizations", "name string", "kept string, kind string, parent string",
    [
        ("Houston, City  of", "City of Houston", "government", None), ("texas general land office", "Texas GLO", "government", None), ("Harris County Flood Control District", "Harris County Flood Control District", "quasi-governmental", "Harris County"),
        ("Horne LLP", "Horne LLP", "private", "Texas GLO"), ("Mercy Foundation", "Mercy Foundation", "nonprofit", "Texas GLO"), ("Houston Housing Authority", "Houston Housing Authority", "government", "City of Houston"),
        ("Somebody", "Somebody", "unknown", "Texas GLO"),
    ],
    lambda df, *keep: df.withColumn("kept", R.organization(F.col("name"))).withColumn("kind", R.org_kind(F.col("kept"))).withColumn("parent", R.parent_org(F.col("kept"))),
)

literal(
    "responsible_organizations", "text string", "org string",
    [
        ("x Responsible Organization: $0.00 Texas General Land Office Rehabilitation/reconstruction of", "Texas General Land Office"), ("Responsible Organization: Alvin, City of $ 5.00 Under Way", "Alvin, City of $ 5.00"),
        ("Responsible Organization: $1.00 Acquisition - general", None), ("none", None),
    ],
    lambda df, *keep: df.select(*keep, "text", R.responsible_org(F.col("text")).alias("org")),
)

_FUNDS = "$ 1,012,727.00 Alvin, City of $ 0.00\n$ 5.50 Houston, City of $ 1.25\n$ 1.00 AB $ 2.00"
literal(
    "funds_by_organization", "text string", "org string, to_date double, this_period double", [(_FUNDS, "Alvin, City of", 1012727.0, 0.0), (_FUNDS, "City of Houston", 5.5, 1.25)],
    lambda df, *keep: df.select(*keep, "text", F.inline(R.funds_table(F.col("text")))),
)

literal(
    "org_candidates", "text string", "candidate boolean, noise boolean",
    [
        ("City of Houston", True, False), ("HUD", True, False), ("DRGR", False, True), ("Total Budget", False, True), ("B-17-DM-48-0001", False, True), ("Label: Office", False, True), ("Parcels", False, True), ("Acme LLC", True, False),
        ("Blue Sky", False, False), ("", False, True),
    ],
    lambda df, *keep: df.select(*keep, "text", R.is_org_candidate(F.col("text")).alias("candidate"), R.is_noise_org(F.col("text")).alias("noise")),
)

literal(
    "oriented_pairs", "a_type string, a string, b_type string, b string", "source string, target string",
    [("TX_COUNTY", "Bee County", "ORG", "HUD", "HUD", "Bee County"), ("ORG", "b", "ORG", "a", "a", "b"), ("DATE", "x", "MONEY", "$5", "$5", "x")],
    lambda df, *keep: df.withColumn("x", R.oriented(F.col("a_type"), F.col("a"), F.col("b_type"), F.col("b"))).select(*keep, "a_type", "a", "b_type", "b", F.col("x.source.text").alias("source"), F.col("x.target.text").alias("target")),
)

literal(
    "narratives", "text string", "narrative string, projects_completed bigint, projects_underway bigint, households_served bigint, properties_acquired bigint, units_completed bigint",
    [
        ("Activity Progress Narrative:\n12 homes were completed,\n 3 projects are underway. No Activity Locations", "12 homes were completed, 3 projects are underway.", 12, 3, None, None, None),
        ("Activity Progress Narrative: Served 40 households; closed on 7 buyout properties; completed 9 housing units. 5 Community Development Systems", "Served 40 households; closed on 7 buyout properties; completed 9 housing units.", None, None, 40, 7, 9),
        ("Activity Progress Narrative: short", None, None, None, None, None, None),
    ],
    lambda df, *keep: df.withColumn("narrative", R.narrative(F.col("text"))).select(*keep, "text", "narrative", R.narrative_metrics(F.col("narrative")).alias("x")).select(*keep, "text", "narrative", "x.*"),
)

literal(
    "places_in_text", "text string", "county string, city string",
    [("in Fort Bend County near", "Bend County", None), ("County of Bee, City of Beeville", "Bee County", "Beeville"), ("by Port Arthur", None, "Port Arthur"), ("nowhere", None, None)],
    lambda df, *keep: df.select(*keep, "text", R.county_in_text(F.col("text")).alias("county"), R.city_in_text(F.col("text")).alias("city")),
)

literal(
    "addresses", "address string, city string, zip string", "clean string, full string",
    [
        ("00 - 12 Main St (rear)", "Houston", "77001", "12 Main St", "12 Main St, Houston, TX, 77001"), ("Elm Rd approximately 5 miles", "", None, "Elm Rd", "Elm Rd, TX"), ("Oak Ave 200 linear feet north", None, "77002", "Oak Ave", "Oak Ave, TX, 77002"),
        ("(none)", "Alvin", None, "(none)", "(none), Alvin, TX"), (None, "Alvin", "77511", None, "Alvin, TX, 77511"),
    ],
    lambda df, *keep: df.withColumn("clean", R.clean_address(F.col("address"))).withColumn("full", R.full_address(F.col("clean"), F.col("city"), F.lit("TX"), F.col("zip"))),
)

literal(
    "normal_values", "value string", "county string, zip string, geoid string",
    [(" Fort Bend County ", "fortbend", "", "fortbendcounty"), ("77001-1234", "770011234", "77001", "770011234"), (None, "", "", "")],
    lambda df, *keep: df.select(*keep, "value", *[R.normal_value(F.col("value"), m).alias(m) for m in ("county", "zip", "geoid")]),
)

literal(
    "header_roles", "headers string", "address int, city int, zip int, latitude int, longitude int",
    [("Site Address|City|ZIP code|Lat|Long|City 2", 0, 1, 2, 3, 4), ("Street|Platform|Latitude (deg)", 0, None, None, 2, None), ("|", None, None, None, None, None)],
    lambda df, *keep: df.withColumn("m", R.column_roles(F.split("headers", "\\|"))).select(*keep, "headers", *[F.try_element_at("m", F.lit(r)).alias(r) for r in ("address", "city", "zip", "latitude", "longitude")]),
)

literal(
    "locations_in_lines", "line string", "zip string, city string, state string, latitude double, longitude double, census_tract string, block_group string, geoid string, county string",
    [
        ("ZIP Code: 77001-1234", "77001-1234", None, None, None, None, None, None, None, None), ("la porte, TX 77571", "77571", "La Porte", "TX", None, None, None, None, None, None),
        ("Latitude: 29.7604, Longitude: 95.3698", None, None, None, 29.7604, -95.3698, None, None, None, None), ("at 48.8566, 2.35220", None, None, None, None, None, None, None, None, None),
        ("Census Tract 2231.01 Block Group 2", None, None, None, None, None, "2231.01", "2", None, None), ("GEOID 482012231001 in Fort Bend County", None, None, None, None, None, None, None, "482012231001", "Fort Bend"),
    ],
    lambda df, *keep: df.select(*keep, "line", R.location_facts(F.col("line")).alias("x")).select(*keep, "line", "x.*"),
)

literal(
    "fund_switches", "text string, n_orgs int", "keyword string, from string, to string, score int, confidence string",
    [
        ("Funds were reallocated from housing repair to roads because of need, $5 in all.", 0, "reallocat", "housing repair", "roads because of need, $5 in all", 5, "high"),
        ("The budget was reprogrammed.", 3, None, None, None, None, None), ("They moved funds from A-street to B-street.", 0, "move", "A-street", "B-street", 2, "low"),
        ("An automatic transfer switch was bought with grant funds for the two clinics.", 2, None, None, None, None, None), ("He was reassigned from the office in Dallas to the one in Austin.", 2, None, None, None, None, None),
        ("An allocation of 1,250,000 was redirected by both of the agencies.", 2, "redirect", None, None, 3, "medium"), ("An allocation of 1,250,000 was redirected by one of the agencies.", 1, None, None, None, None, None),
        ("He was reassigned to another desk in the main building of the state, and a very long way from there it was said that a clerk shifted funds.", 2, None, None, None, None, None),
        ("The grant was reprogrammed in order to meet   new needs of the county.", 5, "reprogram", None, None, 2, "low"), ("", 2, None, None, None, None, None), (None, None, None, None, None, None, None),
    ],
    lambda df, *keep: df.select(*keep, "text", "n_orgs", R.fund_switch(F.col("text"), F.col("n_orgs")).alias("x")).select(*keep, "text", "n_orgs", "x.*"),
)

literal(
    "document_kinds", "text string", "kind string, amendment int",
    [("State of Texas Action Plan Amendment No. 3", "Action Plan", 3), ("QPR 2024", "Progress Report", None), ("Amendment #12", "Unknown", 12), (None, "Unknown", None)],
    lambda df, *keep: df.select(*keep, "text", R.document_kind(F.col("text")).alias("kind"), R.amendment_number(F.col("text")).alias("amendment")),
)

literal(
    "project_fields", "text string", "number string, title string",
    [("Project Number:\n0001\nProject Title: ADMIN  STATE", "0001", "ADMIN STATE"), ("x\n 0042 / HOUSING PROGRAM", "0042", "HOUSING PROGRAM"), ("none", None, None)],
    lambda df, *keep: df.select(*keep, "text", R.project_number(F.col("text")).alias("number"), R.project_title(F.col("text")).alias("title")),
)

literal(
    "entity_normal_forms", "type string, text string", "normal string",
    [
        ("FEMA_DECLARATION", "DR-4332", "4332"), ("GRANT_NUMBER", "b-17-dm-48-0001", "B-17-DM-48-0001"), ("TX_COUNTY", "fort bend county", "Fort Bend County"), ("TX_COUNTY", "county of bee", "County Of Bee County"),
        ("PROGRAM", "hap", "Homeowner Assistance Program"), ("PROGRAM", "buyout program", "Buyout Program"), ("DISASTER", "HURRICANE of THE gulf", "Hurricane of the Gulf"), ("ORG", " HUD ", "HUD"),
    ],
    lambda df, *keep: df.select(*keep, "type", "text", T.normalize_entity(F.col("type"), F.col("text")).alias("normal")),
)

literal(
    "loose_amounts", "text string", "amount double",
    [
        ("$1,234.50", 1234.5), ("57.5M", 57500000.0), ("57.5m", 57.5), ("$5 Billion in all", 5000000000.0), ("2B", 2000000000.0), ("2B of 3", 2.0), ("3 million or 2B", 3000000000.0), ("1.2.3", None), ("none", None), ("", None), (None, None),
    ],
    lambda df, *keep: df.select(*keep, "text", T.loose_usd(F.col("text")).alias("amount")),
)

literal(
    "sizes_and_quarters", "bytes bigint, year int, quarter int", "size string, label string",
    [(512, 2025, 4, "512.0 B", "Q4 2025"), (2048, 0, 1, "2.0 KB", "Unknown"), (5 << 20, None, 1, "5.0 MB", "Unknown"), (3 << 30, 2019, 2, "3.0 GB", "Q2 2019")],
    lambda df, *keep: df.select(*keep, "bytes", "year", "quarter", T.format_size(F.col("bytes")).alias("size"), T.format_quarter(F.col("year"), F.col("quarter")).alias("label")),
)

literal(
    "categories_of_codes", "code string", "category string",
    [("HCFCD_1", "Harris County"), ("PLANNING_X", "Planning"), ("Hou_5", "City of Houston"), ("LBAP_2", "Local Buyout/Acquisition"), ("ZZZ", "Other")],
    lambda df, *keep: df.select(*keep, "code", fin.category_of(F.col("code")).alias("category")),
)
