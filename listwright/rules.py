"""Rule tables of family listings, as data."""

from __future__ import annotations

# Patterns of titles that aren't for families, in any case.
ADULT_TITLES = [
    r"\b21\+", r"\b18\+",
    r"\b21\s*and\s*(over|up)\b", r"\b18\s*and\s*(over|up)\b",
    r"\b21\s*&\s*(over|up)\b",
    r"\badults?\s*only\b", r"\bmature\s*audiences?\b",
    r"\bfor\s+adults\b",
    r"\badult\s+(enrichment|craft|coloring|book\s*club|yoga|meditation|fitness|workshop|class|program|lecture|seminar)\b",
    r"\b(makerspace|workshop|class|program|seminar|lecture)\s+for\s+adults\b",
    r"\bsenior\s+(center|citizen|group|club|program|activity|fitness|yoga|exercise)\b",
    r"\bseniors?\s+only\b",
    r"\b(computer|tech|smartphone|iphone)\s+(basics?|help|class|101)\b",
    r"\besl\s+(class|conversation|group)\b",
    r"\b(resume|job\s+search|career)\s+(help|workshop|class)\b",
    r"\btax\s+(prep|preparation|help|clinic)\b",
    r"\b(medicare|social\s+security|aarp|notary|legal\s+clinic)\b",
    r"\b(blood\s+pressure|health\s+screening|caregiver\s+support)\b",
    r"\b(grief\s+support|bereavement|dementia|alzheimer)\b",
    r"\bnaturalization\s+(ceremony|class|workshop)\b",
    r"\bcitizenship\s+(class|prep|workshop)\b",
    r"\bknitting\s+(circle|group|club)\b", r"\bcrochet\s+(circle|group|club)\b",
    r"\bbook\s+club\s+for\s+adults\b",
    r"\bbingo\s+(night|for\s+seniors)\b",
    r"\bwine\s+(tasting|pairing|dinner|night)\b",
    r"\bbar\s+crawl\b", r"\bhappy\s+hour\b",
    r"\bcocktail\s+(class|making|hour|party)\b",
    r"\bbrewing\s+(class|workshop)\b",
    r"\bspeed\s+dating\b", r"\bsingles\s+(mixer|event|night)\b",
    r"\bnetworking\s+(event|mixer|happy\s+hour)\b",
    r"\b(?:monthly\s+)?(?:corepower\s+)?(?:yoga|pilates|breathwork)\s+(?:on\s+the\s+green|class|session|break)\b",
    r"\bself\s+care:\s*yoga\b", r"\bwellness\s+break\b",
    r"\bbeer\s+(?:tasting|festival|day|crawl)\b",
    r"\bwhisk(?:e?y)\s+tasting\b", r"\bspirits?\s+tasting\b",
    r"\bblind\s+tasting\b", r"\braise\s+a\s+glass\b",
    r"\btantra\b", r"\bdate\s+night\s*\(for\s+couples\)",
    r"\bboard\s+(?:meeting|of\s+trustees)\b",
    r"\bcancell?ed\b",
    r"\bblood\s+drive\b",
    r"\bveterans?\s+(?:resource|day\s+event)\b",
    r"\+\s*(?:family\s+)?hiking\s+recs?\b",
    r"\brecs?\s+nearby\b",
    r"\b\d+\+?\s+(?:nature\s+centers?|places?\s+to|things?\s+to|ways?\s+to)\b",
]

# Patterns of descriptions that aren't for families, in any case.
ADULT_TEXTS = [
    r"\b21\+\s*(?:event|show|only|venue|required|admission)",
    r"\b18\+\s*(?:event|show|only|venue|required|admission)",
    r"must\s+be\s+21", r"must\s+be\s+18",
    r"\bno\s+(?:one\s+)?under\s+(?:21|18)\b",
    r"\bdesigned\s+for\s+adults\b", r"\badult\s+program\b",
    r"\bage[sd]?\s+18\s*\+", r"\bages?\s+55\s*\+", r"\bages?\s+60\s*\+",
    r"\bfor\s+older\s+adults\b",
    r"\badults?\s+only\b",
]

# Comedy clubs, whose listings of API sources aren't for families.
COMEDY_VENUES = [
    "irvine improv", "brea improv", "ontario improv", "tempe improv",
    "the improv", "comedy store", "laugh factory", "ice house comedy",
    "cellar comedy", "comedy cellar",
]
API_SOURCES = ["seatgeek", "ticketmaster", "yelp", "eventbrite"]

# Sites whose texts, titles and pictures are reworded.
AGGREGATORS = ["oc-parent-guide", "mommypoppins", "macaronikid"]

# Patterns of titles and texts of religious services, in any case.
RELIGIOUS = [
    r"\b(worship|church|sunday)\s+service", r"\bbible\s+stud(y|ies)\b", r"\bprayer\s+(group|meeting|call|chain|night|gathering)",
    r"\bsermon\s+series\b", r"\bbaptism\s+(class|prep)", r"\b(men'?s|women'?s)\s+(ministry|fellowship|group|study|bible)",
    r"\brecovery\s+(group|ministry|program|meeting)", r"\bcelebrate\s+recovery\b", r"\bmission\s+trip\b", r"\b(adult|senior)\s+retreat\b",
    r"\bcollege\s+(dinner|ministry|group|night)\b", r"\byoung\s+adult\s+(group|night|service|ministry)\b", r"\bdevotional\b",
    r"\bconfirmation\s+class\b", r"\bcommunion\b", r"\bliturgy\b", r"\bgriefshare\b", r"\bgrief\s+support\b", r"\bdivorcecare\b",
    r"\bfinancial\s+peace\b", r"\bmarriage\s+(counseling|ministry|enrichment)\b", r"\bdoor\s+hanger\s+walk\b", r"\bvolunteer\s+training\b",
    r"\bleadership\s+(training|meeting|summit)\b", r"\bstaff\s+meeting\b", r"\bnewcomers?\s+(class|lunch|dinner)\b", r"\bmembership\s+class\b",
    r"\bsmall\s+group", r"\blife\s+group", r"\bvolunteer\s+orientation\b", r"\bvolunteer\s+training\b", r"\bopen\s+share\b", r"\bdivorce\s+care\b",
    r"\besl\b", r"\benglish\s+as\s+a\s+second", r"\bline\s+dancing\b", r"\blongevity\s+fitness\b", r"\bweekly\s+prayer\b", r"\bfood\s+pantry\s+serve\b",
    r"\bneighborhood\s+walk\b", r"\bsaturday\s+nights?\s+at\b", r"\bsunday\s+morning\b", r"\bwelcome\s+to\s+\w+\b", r"\bchild\s+dedication\b",
    r"\b(women'?s|men'?s)\s+(retreat|tea|spring|fall|breakfast|bbq|luncheon)", r"\bseniors?\s+(on.campus|community|luncheon|group)\b",
    r"\bempowerment\s+study\b", r"\bcouples'?\s+night\b", r"\bseder\s+meal\b", r"\bpassover\b", r"\bhuddle\b", r"\btownhall\s+meeting\b",
    r"\bbaptism\s+at\b", r"\bactivate\b", r"\bsing.a.long\b", r"\bnew\s+admins?\b", r"\bcoaches?\s+information\b", r"\bextensions?\s+experiment\b",
    r"\bsaturday\s+nights?\s+with\b", r"\bhome\s+build\s+faith\b", r"\bfaith\s+adventure\b", r"\bbackyard\s+bbq\b", r"\bsaddleback\s+women\b",
    r"\bwednesday\s+pm\b", r"\bcelebrating\s+\d+\s+years\b", r"\bspring\s+brunch\b", r"\bactiva\b", r"\brevival\b", r"\bbaptize\b",
    r"\bcollege\s+preview\b", r"\bpreview\s+day\b", r"\bworship\s+night\b", r"\bgood\s+friday\b", r"\beaster\s+sunday\b", r"\bdiscipleship\b",
    r"\bmosaic\s+houses\b", r"\bmen'?s\s+\d+\s+hour\b", r"\byouth\s+night\b", r"\bcouple'?s\s+dinner\b", r"\binternship\b", r"\bfreedom\s+night\b",
    r"\bvocational\s+group", r"\bcommunity\s+group\s+leader", r"\bregional\s+prayer\b", r"\bnew\s+at\s+reality", r"\beaster\s+baptism",
]

# Patterns of titles of meetups for the members of a platform; the first counts in capitals only.
MEETUPS = [
    r"\bUYE\b", r"(?i)\byelp\s+(elite|community|event)\b", r"(?i)\byelp\s+\w+\s+(lunch|dinner|brunch|meetup|mixer|party)\b", r"(?i)\blunch\s+with\s+\w+\b",
    r"(?i)\bdinner\s+with\s+\w+\b", r"(?i)\bnextdoor\s+(event|meetup)\b", r"(?i)\bcommunity\s+meetup\b",
]

# Words in titles of library events that aren't for families.
LIBRARY_ADULT = [
    "esl conversation", "esl class", "english as a second", "citizenship", "naturalization", "immigration", "job help", "job search", "resume",
    "career workshop", "career fair", "tax prep", "tax preparation", "notary", "legal clinic", "financial planning", "aarp", "senior", "seniors only",
    "medicare", "social security", "bingo", "bridge club", "book club for adults", "adult book", "adult coloring", "adult craft", "adult enrichment",
    "adult program", "adult workshop", "adult class", "for adults", "makerspace for adults", "adults only", "knitting circle", "crochet circle",
    "quilting", "meditation for adults", "yoga for adults", "blood pressure", "health screening", "caregiver", "dementia", "alzheimer", "grief support",
    "bereavement", "computer class", "computer basics", "tech help", "drop in tech", "drop-in tech", "smartphone basics", "iphone basics",
    "ipad basics", "internet basics", "email basics", "networking event", "business workshop", "professional development", "board meeting",
    "board of trustees", "friends of the library meeting", "veterans resource", "veterans day event", "cancelled", "canceled", "wellness workshop",
    "mental wellness", "life balance", "genealogy", "memoir writing", "watercolor for adults",
]

# Sources whose coordinates are kept when listings are processed anew, and hosts of stock pictures and of other sites' pictures.
TRUSTED_PLACES = ["ticketmaster", "seatgeek", "yelp", "eventbrite", "kidsguide"]
BORROWED_PICTURES = ["unsplash.com", "images.pexels.com", "mommypoppins.com", "macaronikid.com", "orangecountyparentguide.com", "squarespace.com", "sqsp.net"]
PLACE_PHOTOS = ["lh3.googleusercontent.com/place-photos", "lh3.googleusercontent.com/places"]
NO_EVENT_PAGES = ["google.com/search", "mommypoppins.com", "macaronikid.com"]

# The city that stands for a metro, its state, and its box (least and largest latitude, least and largest longitude).
METRO_CITIES = {
    "los-angeles": "Los Angeles, CA", "orange-county": "Irvine, CA", "new-york": "New York, NY", "dallas": "Dallas, TX", "chicago": "Chicago, IL", "atlanta": "Atlanta, GA",
}
METRO_STATES = {"los-angeles": "CA", "orange-county": "CA", "new-york": "NY", "dallas": "TX", "chicago": "IL", "atlanta": "GA"}
METRO_BOXES = {
    "los-angeles": (33.5, 34.5, -118.9, -117.5), "orange-county": (33.3, 34.0, -118.2, -117.3), "new-york": (40.4, 41.2, -74.5, -73.5),
    "dallas": (32.4, 33.4, -97.5, -96.3), "chicago": (41.5, 42.2, -88.2, -87.3), "atlanta": (33.4, 34.2, -84.8, -83.8),
}

# Names that stand where a city should, but are regions or venues.
GENERIC_CITIES = [
    "orange county", "los angeles", "la", "oc", "southern california", "socal", "greater los angeles", "greater orange county",
    "discovery cube oc", "discovery cube", "disneyland", "disney california adventure", "knott's berry farm", "knotts berry farm", "universal studios",
    "irvine spectrum", "south coast plaza", "the great park", "irvine park railroad", "tanaka farms",
]

# Cities that titles name, in the order in which they are looked for.
TITLE_CITIES = [
    "Corona del Mar", "Newport Coast", "Laguna Niguel", "Laguna Hills", "Laguna Woods", "Laguna Beach", "Huntington Beach", "Newport Beach", "Mission Viejo", "Lake Forest",
    "Rancho Santa Margarita", "San Juan Capistrano", "Aliso Viejo", "San Clemente", "Dana Point", "Fountain Valley", "Garden Grove", "Yorba Linda", "Buena Park",
    "Santa Ana", "Costa Mesa", "Fullerton", "Anaheim", "Placentia", "La Habra", "Stanton", "Cypress", "Westminster", "Los Alamitos", "Seal Beach", "Irvine",
    "Tustin", "Orange", "Brea", "Villa Park", "Santa Monica", "Long Beach", "Pasadena", "Burbank", "Glendale", "Torrance",
    "El Segundo", "Culver City", "Inglewood", "Hawthorne", "Redondo Beach", "Hermosa Beach", "Manhattan Beach", "Malibu", "Calabasas", "Thousand Oaks",
    "Chatsworth", "Northridge", "Sherman Oaks", "Studio City", "Van Nuys", "North Hollywood", "Hollywood", "West Hollywood", "Koreatown",
]

# States whose whole names stand in addresses.
STATE_NAMES = ["california", "new york", "texas", "illinois", "georgia", "florida"]

# How titles and texts name a venue or an address.
VENUE_AT = r"(?i)\bat\s+(?:the\s+)?([A-Z][A-Za-z'\-& ]{2,40}(?:Park|Museum|Center|Centre|Library|Hall|Arena|Stadium|Theater|Theatre|Zoo|Garden|Gallery|Church|School|Academy|Farm|Ranch|Beach|Pool|Pavilion|Plaza|Square)?)"
VENUE_COLON = r"(?i)(?:venue|location|place|where):\s*([A-Z][A-Za-z'\-& ]{2,40})"
VENUE_DASH = r"[–—-]\s*([A-Z][A-Za-z'\-& ]{2,40}(?:Park|Museum|Center|Centre|Library|Hall|Arena|Stadium|Theater|Theatre|Zoo|Garden|Gallery|Church|School|Farm|Ranch))"
VENUE_IN_TEXT = r"(?i)(?:at|@|held at|located at|venue:\s*)\s+([A-Z][A-Za-z'\-& ]{2,50}(?:Park|Museum|Center|Centre|Library|Hall|Arena|Stadium|Theater|Theatre|Zoo|Garden|Gallery|Church|School|Academy|Institute|Pavilion|Plaza|Square|Beach|Pool|Farm|Ranch|Brewery|Restaurant|Cafe|Studios?)?)"
VENUE_HINT = r"(?i)(?:at|@|held at|located at|venue:\s*)\s+([A-Z][A-Za-z'\- ]{2,40}(?:Park|Museum|Center|Centre|Library|Hall|Arena|Stadium|Theater|Theatre|Zoo|Garden|Gallery|Church|School|Academy|Institute|Pavilion|Plaza|Square|Beach|Pool|Farm|Ranch|Brewery|Restaurant|Cafe|Studios?)?)"
STREET_IN_TEXT = r"(?i)\b(\d{1,6}\s+(?:[NSEW]\.?\s+)?[A-Z][a-zA-Z]+(?:\s+[A-Z][a-zA-Z]+){0,3}\s+(?:St(?:reet)?|Ave(?:nue)?|Blvd|Boulevard|Dr(?:ive)?|Rd|Road|Ln|Lane|Way|Pl(?:ace)?|Ct|Court|Pkwy|Parkway|Cir(?:cle)?|Hwy|Highway|Trail|Ter(?:race)?)\.?(?:,?\s+(?:Suite|Ste|Apt|#)\s*\d+)?(?:\s*,\s*[A-Z][a-zA-Z\s]+)?(?:\s*,\s*[A-Z]{2})?(?:\s+\d{5}(?:-\d{4})?)?)\b"
ZIP_IN_TEXT = r"([A-Z][a-zA-Z\s]+,\s*[A-Z]{2}\s+\d{5})"

# Places whose names tell that a listing belongs to Orange County.
ORANGE_COUNTY = [
    "anaheim", "irvine", "santa ana", "huntington beach", "costa mesa",
    "orange", "fullerton", "mission viejo", "lake forest", "laguna",
    "laguna beach", "laguna niguel", "laguna hills", "laguna woods",
    "newport beach", "newport coast", "tustin", "yorba linda", "brea",
    "placentia", "cypress", "garden grove", "westminster", "midway city",
    "fountain valley", "seal beach", "san clemente", "dana point",
    "san juan capistrano", "aliso viejo", "rancho santa margarita",
    "ladera ranch", "trabuco canyon", "coto de caza", "foothill ranch",
    "buena park", "la habra", "stanton", "los alamitos", "rossmoor",
    "silverado", "modjeska canyon", "villa park",
    "capistrano beach", "monarch beach", "talega",
    "discovery cube oc", "oc fair", "orange county", "south coast plaza",
    "spectrum center", "irvine spectrum", "the lab anti-mall",
    "bowers museum", "pretend city", "adventure playground",
    "great park", "tanaka farms", "knott's", "knotts",
    "medieval times buena park",
]

# A title that names several places, as articles about them do.
SEVERAL_PLACES = r"(?i)\bin\s+[\w\s]+(?:,\s+[\w\s]+){2,},?\s+and\s+[\w\s]+"
