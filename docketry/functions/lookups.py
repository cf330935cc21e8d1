"""Fixed values that results depend on."""

from __future__ import annotations

# Sector names by two-digit industry code.
SECTORS = {
    "00": "Unknown", "11": "Agriculture", "21": "Mining", "22": "Utilities", "23": "Construction", "31": "Manufacturing",
    "32": "Manufacturing", "33": "Manufacturing", "42": "Wholesale Trade", "44": "Retail Trade", "45": "Retail Trade",
    "48": "Transportation", "49": "Warehousing", "51": "Information", "52": "Finance", "53": "Real Estate",
    "54": "Professional Services", "55": "Management", "56": "Admin Services", "61": "Education", "62": "Healthcare",
    "71": "Arts/Entertainment", "72": "Accommodation/Food", "81": "Other Services", "92": "Public Admin",
}

# Descriptions of often cited standards; the first key that is a prefix counts.
STANDARDS = {
    "1910.134": "Respiratory Protection",
    "1910.147": "Control of Hazardous Energy (Lockout/Tagout)",
    "1926.501": "Fall Protection",
    "1910.178": "Powered Industrial Trucks (Forklifts)",
    "1910.1200": "Hazard Communication",
    "1926.1053": "Ladders",
    "1910.305": "Electrical - Wiring Methods",
    "1926.451": "Scaffolding",
    "1910.212": "Machine Guarding",
    "1910.303": "Electrical - General Requirements",
}

# Words in company names that tell a sector; the first rule that matches counts.
SECTOR_WORDS = (
    (("POSTAL SERVICE", "VETERANS ADMINISTRATION", "DEPARTMENT OF", "FEDERAL", "GOVERNMENT"), "92"),
    (("HOSPITAL", "MEDICAL CENTER", "CLINIC", "HEALTH", "CARE CENTER"), "62"),
    (("SCHOOL", "UNIVERSITY", "COLLEGE", "EDUCATION"), "61"),
    (("TRANSPORT", "SHIPPING", "LOGISTICS", "DELIVERY", "PARCEL SERVICE", "RAILROAD", "AIRLINE"), "48"),
    (("STORE", "RETAIL", "MARKET", "SUPERMARKET", "SHOPPING"), "44"),
    (("STEEL", "MANUFACTURING", "FACTORY", "PAPER", "CHEMICAL", "ELECTRIC", "MOTOR", "AUTOMOTIVE"), "33"),
    (("CONSTRUCTION", "BUILDING", "CONTRACTOR"), "23"),
    (("MINING", "MINE", "COAL"), "21"),
    (("POWER", "ELECTRIC UTILITY", "GAS COMPANY", "WATER COMPANY"), "22"),
    (("HOTEL", "RESTAURANT", "FOOD SERVICE", "LODGING"), "72"),
)

# Company name endings, cut in this order.
SUFFIXES = (
    " INC", " LLC", " CORP", " CORPORATION", " LP", " LTD", " COMPANY", " CO", " L.L.C.", " INC.", " CORP.", " CO.", " PLC",
    " PLLC", " LLP", " PA", " PC", " P.C.", " LLC.", " INCORPORATED", " LIMITED", " ASSOCIATES", " ASSOCIATION", " GROUP",
    " HOLDINGS", " HOLDING",
)
ARTICLES = ("THE", "A", "AN")

# State and territory codes.
STATES = tuple(
    "AL AK AZ AR CA CO CT DE FL GA HI ID IL IN IA KS KY LA ME MD MA MI MN MS MO MT NE NV NH NJ NM NY NC ND OH OK OR PA RI SC SD TN TX UT VT VA WA WV WI WY DC PR VI AS GU MP".split()
)

AGENCIES = ("OSHA", "EPA", "MSHA", "FDA")
