"""Rule values. Order matters wherever a list is ordered: the first match wins.

Everything in this module is a fixed value that results depend on (names, weights, boxes,
word lists, sentences); the logic that uses it lives in the other modules.
"""

# --- fixed values: city boxes (lat_min, lat_max, lon_min, lon_max) -------------------------
CITY_BOXES = {
    "nyc": ("New York City", 40.4, 41.0, -74.3, -73.7),
    "london": ("London", 51.28, 51.69, -0.51, 0.33),
    "chicago": ("Chicago", 41.64, 42.02, -87.94, -87.52),
}
DEFAULT_CITY = "nyc"
CITY_AREA_KM2 = 783.8

# --- fixed values: place name -> city code ------------------------------------------------
CITY_ALIASES = {
    "nyc": [
        "new york", "new york city", "new york county", "nyc", "manhattan", "brooklyn",
        "kings county", "queens", "queens county", "bronx", "bronx county", "staten island",
        "richmond county",
    ],
    "london": [
        "london", "greater london", "city of london", "city of westminster", "westminster",
        "tower hamlets", "camden", "islington", "hackney", "southwark", "lambeth",
    ],
    "chicago": ["chicago", "cook county"],
}
# fixed values: address fields, highest priority first
ADDRESS_FIELDS = [
    "city", "town", "municipality", "village", "county", "state",
    "borough", "suburb", "district", "neighbourhood",
]

# --- fixed values: column aliases, first present alias wins --------------------------------
COLUMN_ALIASES = {
    "latitude": ["lat_lon.latitude", "Latitude"],
    "longitude": ["lat_lon.longitude", "Longitude"],
    "crime_type": ["ofns_desc", "offense_description", "OFNS_DESC"],
    "borough": ["boro_nm", "BORO_NM"],
    "vic_age_group": ["VIC_AGE_GROUP"],
    "vic_race": ["VIC_RACE"],
    "vic_sex": ["VIC_SEX"],
    "cmplnt_fr_dt": ["CMPLNT_FR_DT"],
    "cmplnt_fr_tm": ["CMPLNT_FR_TM"],
}
# fixed values: columns of the stored incident table
STORAGE_COLUMNS = [
    "latitude", "longitude", "crime_type", "crime_category", "severity_weight", "occurred_at",
    "hour_of_day", "day_of_week", "borough", "vic_age_group", "vic_race", "vic_sex",
]
REQUIRED_COLUMNS = ["latitude", "longitude", "crime_type"]

# --- fixed values: offense standardisation (pattern on upper case -> name) -----------------
OFFENSE_PATTERNS = [
    ("ASSAULT.*3", "ASSAULT_3"),
    ("HARRASSMENT", "HARASSMENT"),
    ("DRIVING WHILE INTOXICATED", "DWI"),
    ("CRIMINAL MISCHIEF", "CRIMINAL_MISCHIEF"),
    ("SEX CRIMES", "SEX_CRIMES"),
    ("PETIT LARCENY", "PETIT_LARCENY"),
    ("GRAND LARCENY", "GRAND_LARCENY"),
]
# fixed values: offense name fragment -> category
OFFENSE_CATEGORIES = [
    ("RAPE", "sexual"),
    ("SEX_CRIMES", "sexual"),
    ("HARASSMENT", "harassment"),
    ("ASSAULT", "assault"),
    ("ROBBERY", "robbery"),
    ("GRAND_LARCENY", "theft"),
    ("PETIT_LARCENY", "theft"),
    ("BURGLARY", "property"),
    ("CRIMINAL_MISCHIEF", "property"),
]
DEFAULT_CATEGORY = "other"
CATEGORIES = ["sexual", "harassment", "assault", "robbery", "theft", "property", "other"]
# fixed values: offense name fragment -> severity
SEVERITY_WEIGHTS = [
    ("MURDER & NON-NEGL. MANSLAUGHTER", 1.0),
    ("RAPE", 0.95),
    ("FELONY ASSAULT", 0.85),
    ("ROBBERY", 0.80),
    ("ASSAULT_3", 0.70),
    ("BURGLARY", 0.60),
    ("DWI", 0.60),
    ("GRAND_LARCENY", 0.50),
    ("PETIT_LARCENY", 0.40),
    ("HARASSMENT", 0.40),
    ("CRIMINAL_MISCHIEF", 0.30),
]
DEFAULT_SEVERITY = 0.5
# fixed values: whole-number severity by exact offense name
SEVERITY_POINTS = {
    "MURDER & NON-NEGL. MANSLAUGHTER": 10,
    "RAPE": 9,
    "FELONY ASSAULT": 8,
    "ROBBERY": 8,
    "ASSAULT_3": 7,
    "BURGLARY": 6,
    "DWI": 6,
    "GRAND_LARCENY": 5,
    "PETIT_LARCENY": 4,
    "HARASSMENT": 4,
    "CRIMINAL_MISCHIEF": 3,
}
DEFAULT_SEVERITY_POINTS = 3

# --- fixed values: group weights by category -----------------------------------------------
GROUP_WEIGHTS = {
    "general": {"sexual": 1.0, "harassment": 1.0, "assault": 1.0, "theft": 1.0, "robbery": 1.0},
    "women": {"sexual": 1.8, "harassment": 1.5, "assault": 1.3, "theft": 1.0, "robbery": 1.2},
    "children": {"sexual": 2.0, "harassment": 1.3, "assault": 1.5, "theft": 0.8, "robbery": 1.0},
    "elderly": {"sexual": 1.2, "harassment": 1.2, "assault": 1.4, "theft": 1.5, "robbery": 1.6},
}
DEFAULT_GROUP = "general"

# --- fixed values: victim race labels -------------------------------------------------------
RACE_UNKNOWN_WORDS = ["UNKNOWN", "UNSPECIFIED", "N/A", ""]
# every word of a row has to occur; rows in order
RACE_LABELS_8 = [
    ([["WHITE"], ["HISPANIC"]], "WHITE HISPANIC"),
    ([["WHITE"]], "WHITE"),
    ([["BLACK"], ["HISPANIC"]], "BLACK HISPANIC"),
    ([["BLACK", "AFRICAN"]], "BLACK"),
    ([["ASIAN", "CHINESE", "INDIAN"]], "ASIAN"),
    ([["HISPANIC", "LATINO"]], "HISPANIC"),
]
RACE_LABELS_4 = [
    (["WHITE", "WHITE HISPANIC"], "WHITE"),
    (["BLACK", "BLACK HISPANIC"], "BLACK"),
    (["ASIAN", "CHINESE", "KOREAN"], "ASIAN"),
    (["OTHER", "UNKNOWN"], "OTHER"),
]
DEMOGRAPHIC_COLUMNS = ["vic_age_group", "vic_race", "vic_sex"]
# fixed values: stated weight of each victim attribute
STATED_IMPORTANCE = {"vic_age_group": 0.35, "vic_race": 0.40, "vic_sex": 0.25}

# --- fixed values: generated amenities ------------------------------------------------------
AMENITY_TYPES = ["park", "school", "restaurant", "hospital", "police", "subway"]
BOROUGH_CENTRES = [
    ("Manhattan", 40.7831, -73.9712),
    ("Brooklyn", 40.6782, -73.9442),
    ("Queens", 40.7282, -73.7949),
    ("Bronx", 40.8448, -73.8648),
    ("Staten Island", 40.5795, -74.1502),
]
AMENITIES_PER_BOROUGH = 20
AMENITY_SPREAD_DEG = 0.05
RETIREMENT_TYPES = ["nursing_home", "retirement_home"]

# --- fixed values: time buckets (name, first hour, last hour), report order -----------------
TIME_BUCKETS = [("morning", 6, 11), ("afternoon", 12, 17), ("evening", 18, 23), ("night", 0, 5)]

# --- fixed values: safety levels and map colours --------------------------------------------
SAFETY_LEVELS = [(80, "Very Safe"), (60, "Safe"), (40, "Moderate"), (20, "Concerning")]
LOWEST_SAFETY_LEVEL = "High Risk"
SCORE_COLOURS = [(70, "green"), (40, "orange")]
LOWEST_SCORE_COLOUR = "red"

# --- fixed values: address text -------------------------------------------------------------
COORDINATE_PATTERN = r"(-?\d+\.?\d*),\s*(-?\d+\.?\d*)"
BUSINESS_WORDS = ["restaurant", "cafe", "park", "store", "shop", "mall"]

# --- fixed values: amenity word -> (group, concerns, focus) ---------------------------------
AMENITY_CONTEXTS = [
    (["school", "daycare", "kindergarten", "playground"], "children and families",
     ["child safety", "predatory crimes", "traffic safety", "drug activity"],
     "protecting minors"),
    (["senior", "nursing", "retirement", "elderly"], "elderly residents",
     ["assault", "robbery", "scams", "accessibility"], "vulnerable adult protection"),
    (["hospital", "clinic", "medical"], "patients and healthcare workers",
     ["theft", "assault", "parking safety", "emergency access"],
     "healthcare facility security"),
    (["bar", "nightclub", "pub"], "nightlife patrons",
     ["assault", "DWI", "harassment", "late-night crimes"], "evening and night safety"),
    (["restaurant", "cafe", "food"], "diners and visitors",
     ["theft", "harassment", "property crime"], "general public safety"),
    (["park", "recreation"], "families and outdoor enthusiasts",
     ["assault", "theft", "vandalism", "drug activity"], "public space safety"),
]
DEFAULT_CONTEXT = ("general public", ["crime", "safety"], "overall area security")

# --- fixed values: group descriptions -------------------------------------------------------
# (label, words, adds the racial-bias factor)
GROUP_RACES = [
    ("Black", ["black", "african"], True),
    ("White", ["white", "caucasian"], False),
    ("Asian", ["asian"], True),
    ("Hispanic/Latino", ["hispanic", "latino", "latina"], True),
    ("Native American", ["native", "indigenous"], True),
]
RACIAL_FACTOR = "racial_bias"
# (group, words, risk factor)
VULNERABLE_GROUPS = [
    ("children", ["child", "children", "kid", "kids", "baby", "infant"], "child_safety"),
    ("elderly", ["elderly", "senior", "old", "aged"], "elderly_vulnerability"),
    ("women", ["woman", "women", "female", "girl", "girls"], "gender_based_violence"),
    ("lgbtq", ["queer", "lgbtq", "gay", "lesbian", "transgender", "trans", "nonbinary"],
     "hate_crimes"),
    ("pregnant", ["pregnant", "pregnancy"], "physical_vulnerability"),
    ("disabled", ["disabled", "disability", "wheelchair"], "accessibility_safety"),
]
# (type, pattern whose first group is the count)
GROUP_COUNT_PATTERNS = [
    ("women", r"(\d+)\s*(?:white|black|asian|hispanic|latino|latina)?\s*(?:woman|women)"),
    ("men", r"(\d+)\s*(?:white|black|asian|hispanic|latino)?\s*(?:man|men|male)"),
    ("children", r"(\d+)\s*(?:child|children|kid|kids)"),
]

# --- fixed values: sentences of the text report ---------------------------------------------
ANSWER_STATUS = {"found": "ok", "not_found": "Invalid location"}
REPORT_TEXT = {
    "title": "📍 SAFETY ANALYSIS",
    "location": "Location: ",
    "score": "\n🛡️ SAFETY SCORE: ",
    "top": "\n⚠️ TOP CRIME CONCERNS:",
    "nearby": "\nNEARBY ACTIVITY",
    "nearby_total": "Total Nearby Crimes: ",
    "peak": "\n⏰ HIGHEST RISK TIME: ",
    "amenities": "\nNEARBY AMENITIES",
    "amenity_total": "Total amenities within {km} km: ",
    "amenity_types": "Amenities by type:",
    "group": "\n👥 FOR ",
    "concerns": "⚠️ Specific Concerns:",
    "advice": "\n💡 SAFETY RECOMMENDATIONS",
    "of_hundred": ("/100 (", ")"),
    "share": (" (", "% of crimes)"),
    "numbered": ("  ", ". "),
    "dash": "  - ",
    "bullet": "  • ",
    "warning": "  ⚠️ ",
    "is": ": ",
    "incidents": " incidents",
}
# group fragment -> (lines below 60, lines from 60)
CONTEXT_ADVICE = [
    ("children",
     ["⚠️ CAUTION FOR CHILDREN:", "• Consider alternative locations",
      "• Ensure constant adult supervision", "• Avoid isolated areas"],
     ["✓ SAFE FOR CHILDREN with precautions:", "• Maintain supervision during activities",
      "• Teach basic safety awareness"]),
    ("elderly",
     ["⚠️ CAUTION FOR ELDERLY:", "• Use buddy system", "• Consider transportation services"],
     ["✓ SUITABLE FOR ELDERLY with precautions:", "• Ensure good lighting",
      "• Keep emergency contacts ready"]),
    ("nightlife",
     ["⚠️ NIGHTLIFE CAUTION:", "• Travel in groups only", "• Use rideshare services"],
     ["✓ SAFE FOR NIGHTLIFE with precautions:", "• Exercise caution during late hours",
      "• Share location with friends"]),
]
ADVICE_SCORE = 60
# (score below, lines); the last row has no bound
GENERAL_ADVICE = [
    (40, ["\n🚨 HIGH RISK AREA:", "• Exercise extreme caution", "• Avoid walking alone"]),
    (70, ["\n⚠️ MODERATE RISK:", "• Stay aware of surroundings", "• Take normal precautions"]),
    (None, ["\n✓ RELATIVELY SAFE:", "• Standard precautions recommended"]),
]
# group -> (lines below 60, lines from 60, offense words listed after)
GROUP_ADVICE = [
    ("children",
     ["\n👶 CHILDREN: ⚠️ HIGH RISK", "  • Keep within arm's reach",
      "  • Consider alternative locations"],
     ["\n👶 CHILDREN: ✓ Moderate safety", "  • Maintain visual contact"],
     ["KIDNAPPING", "CHILD", "ABUSE", "PREDATORY"]),
    ("women",
     ["\n👩 WOMEN: ⚠️ HEIGHTENED RISK", "  • Travel in groups", "  • Share live location"],
     ["\n👩 WOMEN: ✓ Reasonable safety", "  • Stay in populated areas"],
     ["HARASSMENT", "ASSAULT", "RAPE", "SEX"]),
    ("lgbtq",
     ["\n🏳️‍🌈 LGBTQ+: ⚠️ CAUTION", "  • Stay in LGBTQ+-friendly areas",
      "  • Have support contacts ready"],
     ["\n🏳️‍🌈 LGBTQ+: ✓ Generally safe", "  • Be aware of surroundings"],
     ["HATE", "BIAS", "HARASSMENT"]),
    ("elderly",
     ["\n👴 ELDERLY: ⚠️ HIGH VULNERABILITY", "  • Use buddy system", "  • Consider rideshare"],
     ["\n👴 ELDERLY: ✓ Suitable", "  • Ensure good lighting"],
     []),
]
GROUP_TEXT = {
    "title": "\n🔒 CUSTOM GROUP ANALYSIS",
    "people": ("Group: ", " people"),
    "race": "Race: ",
    "includes": "Includes: ",
    "racial": "\n🛡️ RACIAL SAFETY CONSIDERATIONS:",
    "racial_words": ["HATE", "BIAS", "HARASSMENT"],
    "racial_care": ["  • Be aware of surroundings", "  • Document any incidents",
                    "  • Know emergency contacts"],
    "racial_clear": ["  ✓ No significant bias incidents reported"],
    "solo": ["\n⚠️ SOLO: Higher risk", "  • Share location", "  • Stay in populated areas"],
    "large": ["\n👥 LARGE GROUP: ✓ Safety in numbers", "  • Designate leader",
              "  • Don't split up"],
}
LARGE_GROUP = 5

# --- fixed values: planned risk features ----------------------------------------------------
# (days below, weight); the last row has no bound
TIME_DECAY = [(30, 1.0), (90, 0.7), (None, 0.4)]
EXPOSURE = {
    "woman_alone_bar_night": 1.5,
    "woman_group_bar_night": 0.8,
    "child_accompanied_park_day": 0.5,
    "child_alone": 2.0,
    "elderly_alone_night": 1.8,
}
AMENITY_FRESH_DAYS = 30

# --- fixed values: radii in km --------------------------------------------------------------
INCIDENT_RADIUS_KM = 3.0
AMENITY_RADIUS_KM = 1.0
HOTSPOT_POI_KM = 0.2
INCIDENT_POI_KM = 0.1
INCIDENT_PLACE_KM = 0.5
INCIDENT_CITY_KM = 15.0
POIS_PER_TYPE = 3
FALLBACK_BOX_DEG = 0.01
EARTH_KM = 6371.0
HOTSPOT_EARTH_KM = 6371.0088

# --- fixed values: optional city sources ----------------------------------------------------
SERVICE_REQUEST_KINDS = [
    "Street Light Condition", "Noise - Street/Sidewalk", "Illegal Parking", "Graffiti",
    "Derelict Vehicles", "Homeless Encampment",
]
SERVICE_DATE_FORMATS = ["MM/dd/yyyy hh:mm:ss a", "yyyy-MM-dd'T'HH:mm:ss.SSS", "yyyy-MM-dd'T'HH:mm:ss"]
