"""Word lists, patterns, weights and lookup tables whose exact content decides results."""

from __future__ import annotations

UK, US = "United Kingdom", "United States"

#: Fixed values. US postal abbreviations, by state name.
US_STATES = {
    "Alabama": "AL", "Alaska": "AK", "Arizona": "AZ", "Arkansas": "AR", "California": "CA", "Colorado": "CO",
    "Connecticut": "CT", "Delaware": "DE", "District of Columbia": "DC", "Florida": "FL", "Georgia": "GA", "Hawaii": "HI",
    "Idaho": "ID", "Illinois": "IL", "Indiana": "IN", "Iowa": "IA", "Kansas": "KS", "Kentucky": "KY", "Louisiana": "LA",
    "Maine": "ME", "Maryland": "MD", "Massachusetts": "MA", "Michigan": "MI", "Minnesota": "MN", "Mississippi": "MS",
    "Missouri": "MO", "Montana": "MT", "Nebraska": "NE", "Nevada": "NV", "New Hampshire": "NH", "New Jersey": "NJ",
    "New Mexico": "NM", "New York": "NY", "North Carolina": "NC", "North Dakota": "ND", "Ohio": "OH", "Oklahoma": "OK",
    "Oregon": "OR", "Pennsylvania": "PA", "Rhode Island": "RI", "South Carolina": "SC", "South Dakota": "SD",
    "Tennessee": "TN", "Texas": "TX", "Utah": "UT", "Vermont": "VT", "Virginia": "VA", "Washington": "WA",
    "West Virginia": "WV", "Wisconsin": "WI", "Wyoming": "WY",
}

#: Fixed values. Country aliases in the order in which they are searched.
COUNTRY_ALIASES = {
    "uk": UK, "gb": UK, "great britain": UK, "england": UK, "scotland": UK, "wales": UK, "northern ireland": UK,
    "britain": UK, "usa": US, "us": US, "u.s.": US, "u.s.a.": US, "america": US, "united states of america": US,
}

#: Fixed values. Country-code endings of host names.
COUNTRY_ENDINGS = {
    ".uk": UK, ".de": "Germany", ".fr": "France", ".it": "Italy", ".es": "Spain", ".nl": "Netherlands",
    ".au": "Australia", ".ca": "Canada", ".ie": "Ireland", ".nz": "New Zealand", ".in": "India", ".jp": "Japan",
    ".cn": "China",
}

#: Fixed values. Countries of VAT prefixes, in the order in which they are tried.
VAT_COUNTRIES = {
    "GB": UK, "DE": "Germany", "FR": "France", "IT": "Italy", "ES": "Spain", "NL": "Netherlands", "AU": "Australia",
    "IE": "Ireland",
}

#: Fixed values. New York telephone area codes.
NY_AREA_CODES = [
    "212", "332", "347", "516", "518", "585", "607", "631", "646", "680", "716", "718", "838", "845", "914", "917", "929",
]

#: Fixed values. Counties of New York City names, in lower case.
NY_BOROUGHS = {
    "new york city": "new york", "nyc": "new york", "manhattan": "new york", "brooklyn": "kings", "queens": "queens",
    "bronx": "bronx", "staten island": "richmond",
}

#: Fixed values. Prefixes of UK company numbers.
UK_PREFIXES = ["SC", "NI", "OC", "LP", "SO", "IP", "SL", "NC", "NL", "NZ"]

#: Fixed values. Corporate suffixes in the order in which they are stripped.
CORPORATE_SUFFIXES = [
    "Inc.", "Inc", "LLC", "Ltd.", "Ltd", "Limited", "Corp.", "Corp", "Corporation", "GmbH", "AG", "S.A.", "S.p.A.", "S.L.",
    "Pty Ltd", "B.V.", "N.V.", "PLC", "plc", "SE", "Co., Ltd.", "Co., Ltd", "S.a.r.l.", "K.K.", "Oy", "AB", "ApS", "Holdings",
    "Pte. Ltd.",
]

#: Fixed values. Replacements in company names before UK and New York comparison, in order.
UK_NAME_RULES = [
    (r"\bLIMITED\b", "LTD"), (r"\bPUBLIC LIMITED COMPANY\b", "PLC"), (r"\bPARTNERSHIP\b", "PRTNR"), (r"\bCOMPANY\b", "CO"),
    (r"\bINCORPORATED\b", "INC"), (r"\bCORPORATION\b", "CORP"),
]
NY_NAME_RULES = [
    (r"\bINCORPORATED\b", "INC"), (r"\bCORPORATION\b", "CORP"), (r"\bCOMPANY\b", "CO"), (r"\bLIMITED\b", "LTD"),
    (r"\bLIABILITY\b", ""), (r"\bPARTNERSHIP\b", "PRTNR"),
]

#: Fixed values. E-mail addresses that are placeholders or of machines.
EMAIL_REJECTS = [
    r"^test@test\.com\z", r"^example@example\.com\z", r"^name@example\.com\z", r"^your@email\.com\z", r"^you@example\.com\z",
    r"^john@domain\.com\z", r"^email@domain\.com\z", r"^user@domain\.com\z", r"^admin@domain\.com\z", r"^user@host\.com\z",
    r"^someone@example\.com\z", r"^placeholder@", r"^no-?email@", r"^missing@", r"^sample@", r"^demo@", r"@example\.com\z",
    r"@example\.org\z", r"@example\.net\z", r"@domain\.com\z", r"@yourcompany\.com\z", r"@email\.com\z", r"@sentry\.io\z",
    r"@schema\.org\z", r"@wixpress\.com\z", r"@wordpress\.org\z", r"\.png\z", r"\.jpg\z", r"\.webp\z", r"\.svg\z", r"^noreply@",
    r"^no-reply@", r"^donotreply@",
]

#: Fixed values. Words near an e-mail address that mark it as an example.
EMAIL_EXAMPLE_CUES = [
    "for example", "e.g.", "such as", "sample email", "enter a valid email", "invalid email", "placeholder",
    "your email address", "email@example", "name@company.com", "user@company.com",
]

#: Fixed values. What ends an address block.
ADDRESS_STOPS = [
    r"represented\s+by", r"vertreten\s+durch", r"managing\s+director", r"geschäftsführer", r"directors?", r"company\s+secretary",
    "contact", "phone", "email", "tel", "fax", r"social\s+media", r"fancy\s+social", r"get\s+us\s+on", r"follow\s+us",
    r"connect\s+with\s+us", r"opening\s+hours", r"opening\s+times", "facebook", "twitter", "instagram", "linkedin", "youtube",
    "fb", r"all\s+rights\s+reserved", "cookie", r"privacy\s+policy", "newsletter", "careers", r"confirm\s+your\s+age", "support",
    "faqs", r"shop\s+now",
]
ADDRESS_STOP_TOKENS = ["fb", "facebook", "twitter", "instagram", "linkedin", "social media", "fancy social media channels:"]
STREET_WORDS = (
    r"street|st\.?|road|rd\.?|avenue|ave\.?|boulevard|blvd\.?|lane|ln\.?|drive|dr\.?|way|place|plaza|square|court|ct\.?|house|"
    r"building|bldg\.?|tower|center|centre|park|estate|industrial\s+estate|commercial\s+park|floor|fl\.?|suite|ste\.?|unit|box|"
    r"po box|p\.o\. box|str\.?|straße|strasse|rue|via|calle|piazza|platz"
)
ADDRESS_BOILERPLATE = (
    "we are|our mission|all rights reserved|click here|cookies|privacy policy|applicant notice|terms of service"
)

#: Fixed values. Path keywords with weight and category, in fold order: (words, weight, category).
URL_KEYWORDS = [
    ("imprint", 15, "legal"), ("impressum", 15, "legal"), ("mentions-legales", 15, "legal"), ("mentions_legales", 15, "legal"),
    ("legal-notice", 14, "legal"), ("legal_notice", 14, "legal"), ("legal", 12, "legal"), ("company-details", 14, "legal"),
    ("company-information", 14, "legal"), ("corporate-information", 14, "legal"), ("registration", 13, "legal"),
    ("registered-office", 14.5, "legal"), ("terms", 11, "legal"), ("terms-of-use", 11, "legal"),
    ("terms-and-conditions", 11, "legal"), ("terms-of-service", 11, "legal"), ("privacy-policy", 9, "legal"),
    ("privacy", 8, "legal"), ("policy", 7, "legal"), ("disclaimer", 8, "legal"), ("about", 10, "about"), ("about-us", 12, "about"),
    ("about_us", 12, "about"), ("who-we-are", 12, "about"), ("who_we_are", 12, "about"), ("our-company", 12, "about"),
    ("our_company", 12, "about"), ("our-business", 11, "about"), ("group-profile", 12, "about"), ("company-profile", 12, "about"),
    ("company", 9, "about"), ("corporate", 8, "about"), ("overview", 8, "about"), ("our-story", 9, "about"), ("facts", 7, "about"),
    ("team", 10, "about"), ("our-team", 11, "about"), ("history", 8, "about"), ("contact", 11, "contact"),
    ("contact-us", 13, "contact"), ("contact_us", 13, "contact"), ("get-in-touch", 11, "contact"), ("where-we-are", 11, "contact"),
    ("locations", 11, "contact"), ("offices", 10, "contact"), ("headquarters", 12.5, "contact"),
    ("global-locations", 11, "contact"), ("help", 10, "contact"), ("help-center", 9, "contact"), ("customer-service", 9, "contact"),
    ("store-locator", 9, "contact"), ("find-us", 10, "contact"), ("our-offices", 11, "contact"), ("support", 8, "contact"),
    ("investors", 10, "investor"), ("investor-relations", 12, "investor"), ("leadership", 10, "leadership"),
    ("management", 9, "leadership"), ("directors", 9, "leadership"), ("board-of-directors", 10, "leadership"),
    ("governance", 9, "leadership"), ("subsidiaries", 11, "about"), ("group", 8, "about"), ("annual-reports", 10, "investor"),
    ("financials", 9, "investor"), ("sustainability", 8, "about"), ("esg", 8, "about"), ("newsroom", 9, "news"), ("press", 8, "news"),
    ("press-releases", 10, "news"), ("media", 7, "news"), ("pricing", 9, "business"), ("plans", 8, "business"),
]

#: Fixed values. Bare locale roots, low-value path parts, file endings and tracking parameters.
LOCALE_ROOT = r"^/(?:en|en-[a-z]{2}|de|fr|es|it|pt|ja|zh|zh-[a-z]{2}|nl|ru|ko|ar|pl|sv|da|fi|no|tr|cs|hu|ro)/?\z"
LOW_VALUE_PATHS = [
    "/blog/", "/article/", "/posts/", "/item/", "/shop/", "/store/", "/cart/", "/checkout/", "/category/", "/tag/", "/author/",
    "/search", "/login", "/signin", "/signup", "/register-user", "/account", "/download", "/downloads", "/docs/",
    "/documentation/", "/community/", "/events/", "/webinars/", "/feed/", "/vacancies/", "/jobs/", "/careers/",
]
SKIPPED_SCHEMES = ["mailto:", "tel:", "javascript:", "data:", "#", "whatsapp:"]
SKIPPED_ENDINGS = [
    "png", "jpg", "jpeg", "gif", "webp", "svg", "ico", "bmp", "tiff", "pdf", "doc", "docx", "xls", "xlsx", "ppt", "pptx",
    "csv", "zip", "tar", "gz", "rar", "7z", "exe", "dmg", "apk", "mp3", "mp4", "wav", "avi", "mov", "flv", "webm", "css",
    "js", "mjs", "woff", "woff2", "ttf", "eot", "otf", "xml", "rss", "atom", "json",
]
TRACKING_PARAMETERS = [
    "utm_source", "utm_medium", "utm_campaign", "utm_term", "utm_content", "gclid", "fbclid", "msclkid", "ref", "source",
    "mc_eid", "attribute_pa", "_hsenc", "_hsmi", "v", "amp",
]

#: Fixed values. Page titles that name no company, and openings that are dropped from titles.
GENERIC_TITLES = [
    "about", "history", "contact", "home", "homepage", "welcome", "services", "products", "our story", "who we are", "legal",
    "terms",
]
TITLE_OPENINGS = r"(?i)^(welcome\s+to|home\s+page\s+of|official\s+site\s+of|welcome)\s*"

#: Fixed values. Fields that count for completeness.
IMPORTANT_FIELDS = [
    "company_name", "legal_name", "registration_number", "vat_tax_number", "full_address", "postal_code", "email", "phone",
]

#: Fixed values. Labels of key-value pairs that name a field.
LABEL_ALIASES = {
    "legal_name": ["legal name", "registered name", "official name", "company name", "firmenname", "raisonsociale"],
    "registration_number": [
        "company number", "registration number", "registration no", "company no", "handelsregister", "hrb", "hra", "siren",
        "siret", "kvk", "cvr", "cr no",
    ],
    "vat_tax_number": ["vat number", "vat no", "vat registration", "tax id", "ust-idnr", "tva", "gstin", "ein"],
    "full_address": ["registered office", "registered address", "headquarters", "head office", "address", "firmensitz"],
    "phone": ["telephone", "phone", "tel", "contact number"],
    "email": ["email", "e-mail", "contact email"],
}

#: Fixed values. Schema.org types that are organizations.
ORGANIZATION_TYPES = [
    "Organization", "Corporation", "LocalBusiness", "NGO", "Company", "AutomotiveBusiness", "Brewery",
]

#: Fixed values. Infobox keys and the fields they fill.
INFOBOX_FIELDS = {
    "name": "legal_name", "legal_name": "legal_name", "trade_name": "brand_name", "type": "company_type",
    "industry": "industry", "founded": "founded", "hq_location": "full_address", "headquarters": "full_address",
    "location": "full_address", "parent": "parent_company", "subsid": "subsidiaries", "subsidiaries": "subsidiaries",
    "homepage": "website", "website": "website",
}
