from pyspark.sql import functions as F

from siteloom.operators import registry, reports


def test_uk_profile(spark):
    address = "struct<address_line_1:string,address_line_2:string,locality:string,region:string,postal_code:string,country:string>"
    profiles = spark.createDataFrame(
        [("SC1", "BREWDOG PLC", "active", "plc", None, "2007", ["1105", "56302"], ("Clyde Offices", None, "Glasgow", "", "G2 1BP", None)), ("SC2", "B", None, None, None, None, None, None)],
        f"company_number string, company_name string, company_status string, type string, jurisdiction string, date_of_creation string, sic_codes array<string>, registered_office_address {address}",
    )
    officers = spark.createDataFrame(
        [("SC1", 0, "Ann", "Director", None), ("SC1", 1, "Bob", "secretary", None), ("SC1", 2, "Cy", "director", "2020"), ("SC1", 3, None, "director", None), ("SC1", 4, "Di", "nominee-director", "")],
        "company_number string, ord int, name string, officer_role string, resigned_on string",
    )
    owners = spark.createDataFrame([("SC1", 0, "Ann", "individual", ["25-50"], None, None)], "company_number string, ord int, name string, kind string, natures_of_control array<string>, nationality string, country_of_residence string")
    filings = spark.createDataFrame([("SC1", i, f"2020-{i:02}", "AA", "d", "c") for i in range(12)], "company_number string, ord int, date string, type string, description string, category string")
    charges = spark.createDataFrame([], "company_number string, ord int, charge string")
    insolvency = spark.createDataFrame([("SC1", "none")], "company_number string, insolvency string")
    rows = {r.company_number: r for r in registry.uk_profiles(profiles, officers, owners, filings, charges, insolvency).collect()}
    got = rows["SC1"]
    assert got.full_registered_address == "Clyde Offices, Glasgow, G2 1BP" and got.registered_address.country == "United Kingdom"
    assert got.officers.directors == ["Ann", "Di"] and got.officers.management == ["Bob"]
    assert [f.date for f in got.filing_history] == [f"2020-{i:02}" for i in range(10)] and got.industry == "1105, 56302"
    assert rows["SC2"].officers is None and rows["SC2"].sic_codes == []


def test_ny_profile(spark):
    def table(names, rows):
        return spark.createDataFrame(rows, ", ".join(f"{n} {'int' if n == 'ord' else 'string'}" for n in names.split()))

    names = (
        "dos_id current_entity_name entity_type jurisdiction county initial_dos_filing_date dos_process_name registered_agent_name chairman_name "
        "chairman_address_1 chairman_city chairman_state chairman_zip dos_process_address_1 dos_process_address_2 dos_process_city dos_process_state dos_process_zip"
    )
    corps = table(names, [("1", "ACME", "DBC", "NY", "Kings", "2000", "Agent", None, "Chair", "2 St", "Albany", "NY", "1", "1 St", None, "New York", None, "10001"), ("2", "B", *[None] * 16)])
    resolved = spark.createDataFrame([("k1", "resolved", True, "1"), ("k2", "ambiguous", False, "2"), ("k3", "unresolved", False, "1")], "key string, status string, matched boolean, dos_id string")
    filings = table(
        "corpid_num ord film_num corp_name date_filed approved_date eff_date dura_date dis_eff_date documenttype entitytype mod_certcode law cnty_prin_ofc juris amd_corp_name_flag",
        [("1", i, str(i), "ACME", f"20{i:02}", *[None] * 10, "X" if i else None) for i in range(25)],
    )
    addresses = table("corpid_num ord film_num date_filed addr_type name addr1 addr2 city state zip5 country", [("1", 0, "f", "2020", "3", "n", "9 St", None, "New York", "NY", "10003", None)])
    stock = table("corpid_num ord film_num date_filed stock_type stock_num_shrs stock_val_shr", [])
    entities = table("corpid_num ord film_num date_filed mod_cert_code status", [("1", 0, "f", "2019", "c", "Inactive"), ("1", 1, "f", "2021", "c", ""), ("1", 2, "f", "2020", "c", "Active")])
    rows = {r.key: r for r in registry.ny_profiles(resolved, corps, filings, addresses, stock, entities).collect()}
    got = rows["k1"]
    assert set(rows) == {"k1", "k2"} and got.company_status == "Active" and got.chairman.name == "Chair"
    assert (got.registered_address.zip, got.registered_address.country) == ("10003", "United States")
    assert len(got.filing_history) == 20 and got.filing_history[0].date_filed == "2024" and got.filing_history[0].name_amended
    assert rows["k2"].registered_address.state == "NY" and rows["k2"].filing_history is None


def test_articles_and_views(spark):
    hits = [("q", 0, "A (disambiguation)", "disambiguation page"), ("q", 1, "A Corp", "a firm"), ("r", 0, "B", "Disambiguation")]
    got = registry.article_of(spark.createDataFrame(hits, "query string, hit_ord int, title string, snippet string"))
    assert {r.query: r.title for r in got.collect()} == {"q": "A Corp", "r": "B"}
    profiles = spark.createDataFrame([("s", "x", "1")], "site string, company_name string, dos_id string")
    assert reports.scraped_view(profiles).columns == ["site", "company_name"]


def test_profiles_are_appended(spark, tmp_path):
    rows = spark.createDataFrame([("a.com", "A é")], "site string, company_name string")
    for _ in range(2):
        reports.write_profiles(rows, str(tmp_path / "out"))
    back = spark.read.json(str(tmp_path / "out"))
    assert back.count() == 2 and back.where(F.col("company_name") == "A é").count() == 2
