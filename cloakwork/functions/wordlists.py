"""Replacement vocabularies. Names and streets are built by rule so that no table travels with the job."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from cloakwork.functions.keyed import at

# Own syllables, combined by position.
FIRST_HEADS = (
    "Al An Ar Be Bel Bri Ca Cal Car Ce Co Da Dar De Del Do El Em Er Es Fa Fe Fi Flo Ga Gre Ha Hel Hu In Is Ja "
    "Jo Ju Ka Kel Ki La Le Li Lo Lu Ma Mar Me Mi Na Ne No Ol Pa Pe Qui Ra Re Ro Sa Se Si So Ta Te Va Wi"
).split()
FIRST_TAILS = (
    "bella bert bina brina cara celle cia cus da dan della den dina don dra dric fina gan gina han iana ick "
    "iel ina ion isa issa ka kin la lan lena lia lin lina lo lona lyn ma man mara mina mon na nard nelle "
    "nia nie nora ra ren ria rick rina ron sa sha son ta tha tina ton tor vin zan"
).split()
LAST_HEADS = (
    "Ab Ald Ar Ash Bar Bell Ber Black Blu Bor Brad Bran Bro Bur Cal Car Chal Clay Cole Cor Crow Dal Dan Dar "
    "Del Den Dun East Ed El Em Ever Fair Fal Far Fen Fer Fin Fox Gar Gil Glen Gold Gran Gray Green Hal Ham "
    "Har Hart Haw Hay Hen Hol Hor Hud Hun Ing Jar Ken Kerr King Lan Lang Lark Lat Lin Lock Mar May Mer Mil "
    "Mont Mor Nor Oak Old Or Pal Par Pem Pres Quin Rad Ran Red Rich Rook Rose Rud Sal Shel Sil Stan Stone "
    "Tal Thorn Wal West"
).split()
LAST_TAILS = (
    "ack aday ard aric ason aster away bach bank beck berg bert bo born bourne bridge brook burn bury by cliff "
    "combe cote cott cox croft dale dell den der dine don dorn drake ell en er ering es ett ey fell field ford "
    "forth gard gate ges grave grove ham hart haven head hill holm house hurst ick iday in ing ington land lar "
    "law leigh ley lin ling lock low man mann mark mead mer mere mill mond more mott ner ness nor oak over "
    "park pole ridge rose row sey shaw"
).split()

# Own company names and e-mail domains; the domains end in the reserved .test.
COMPANIES = [
    "Alderbrook Foods", "Birchline Freight", "Copperfield Tools", "Driftwood Media", "Eastmoor Energy", "Fernhill Textiles",
    "Greystone Bearings", "Hollowell Optics", "Ironvale Castings", "Juniper Bay Shipping", "Kestrel Paper", "Larkspur Dental",
    "Millrace Software", "Northgate Glass", "Oakhaven Dairy", "Pinecrest Insurance", "Quarrybank Cement", "Redwater Brewing",
]
SAFE_DOMAINS = ["mailbox.test", "post-office.test", "letters.test", "inbox-one.test", "courier.test", "pigeon.test"]

STREET_NAMES = (
    "Alder Amber Beacon Brook Canyon Clover Coral Cotton Crest Dawn Fern Field Garden Glen Harbor Heron Hill "
    "Iris Ivy Lake Lantern Linden Meadow Mill Moss Orchard Pebble Quarry Raven Ridge River Sage Sparrow Stone "
    "Summit Thistle Timber Valley Willow Wren"
).split()
STREET_KINDS = ["Avenue", "Court", "Drive", "Lane"]

# Own gazetteer (city, state, ZIP): every state capital and a few large cities.
CITIES = [
    "Montgomery,AL,36104", "Juneau,AK,99801", "Phoenix,AZ,85001", "Little Rock,AR,72201", "Sacramento,CA,95814",
    "Los Angeles,CA,90012", "San Diego,CA,92101", "Denver,CO,80202", "Hartford,CT,06103", "Dover,DE,19901",
    "Washington,DC,20001", "Tallahassee,FL,32301", "Miami,FL,33128", "Atlanta,GA,30303", "Honolulu,HI,96813",
    "Boise,ID,83702", "Springfield,IL,62701", "Chicago,IL,60602", "Indianapolis,IN,46204", "Des Moines,IA,50309",
    "Topeka,KS,66603", "Frankfort,KY,40601", "Baton Rouge,LA,70802", "Augusta,ME,04330", "Annapolis,MD,21401",
    "Boston,MA,02108", "Lansing,MI,48933", "Detroit,MI,48226", "Saint Paul,MN,55102", "Jackson,MS,39201",
    "Jefferson City,MO,65101", "Helena,MT,59601", "Lincoln,NE,68502", "Carson City,NV,89701", "Concord,NH,03301",
    "Trenton,NJ,08608", "Santa Fe,NM,87501", "Albany,NY,12207", "New York,NY,10007", "Raleigh,NC,27601",
    "Bismarck,ND,58501", "Columbus,OH,43215", "Oklahoma City,OK,73102", "Salem,OR,97301", "Harrisburg,PA,17101",
    "Philadelphia,PA,19107", "Providence,RI,02903", "Columbia,SC,29201", "Pierre,SD,57501", "Nashville,TN,37219",
    "Austin,TX,78701", "Houston,TX,77002", "Dallas,TX,75201", "Salt Lake City,UT,84111", "Montpelier,VT,05602",
    "Richmond,VA,23219", "Olympia,WA,98501", "Seattle,WA,98104", "Charleston,WV,25301", "Madison,WI,53703",
    "Cheyenne,WY,82001",
]
STATES = sorted({c.split(",")[1] for c in CITIES})

FIRST_SIZE = len(FIRST_HEADS) * len(FIRST_TAILS)
LAST_SIZE = len(LAST_HEADS) * len(LAST_TAILS)
STREET_SIZE = len(STREET_NAMES) * len(STREET_KINDS)


def _pair(heads: list[str], tails: list[str], position: Column, gap: str = "") -> Column:
    n = F.lit(len(heads)).cast("bigint")
    return F.concat(at(heads, position % n), F.lit(gap), at(tails, F.floor(position / n).cast("bigint")))


def first_name(position: Column) -> Column:
    """Name at a position below FIRST_SIZE."""
    return _pair(FIRST_HEADS, FIRST_TAILS, position)


def last_name(position: Column) -> Column:
    """Name at a position below LAST_SIZE."""
    return _pair(LAST_HEADS, LAST_TAILS, position)


def street(position: Column) -> Column:
    """Street at a position below STREET_SIZE."""
    return _pair(STREET_NAMES, STREET_KINDS, position, " ")
