"""Fixed values of the delay features. They must not change, or results change."""

# Public holidays.
HOLIDAYS = [
    "2022-01-01", "2022-04-17", "2022-04-18", "2022-05-01", "2022-05-26", "2022-06-05", "2022-06-06", "2022-07-21", "2022-08-15", "2022-11-01", "2022-11-11", "2022-12-25",
    "2023-01-01", "2023-04-09", "2023-04-10", "2023-05-01", "2023-05-18", "2023-05-28", "2023-05-29", "2023-07-21", "2023-08-15", "2023-11-01", "2023-11-11", "2023-12-25",
    "2024-01-01", "2024-03-31", "2024-04-01", "2024-05-01", "2024-05-09", "2024-05-19", "2024-05-20", "2024-07-21", "2024-08-15", "2024-11-01", "2024-11-11", "2024-12-25",
]
# School holidays, both ends included.
SCHOOL_HOLIDAYS = [
    ("2022-02-28", "2022-03-06"), ("2022-04-04", "2022-04-18"), ("2022-07-01", "2022-08-31"), ("2022-10-24", "2022-11-06"),
    ("2022-12-26", "2023-01-08"), ("2023-02-20", "2023-03-05"), ("2023-04-03", "2023-04-16"), ("2023-05-01", "2023-05-14"),
    ("2023-07-01", "2023-08-31"), ("2023-10-23", "2023-11-05"), ("2023-12-25", "2024-01-07"), ("2024-02-12", "2024-02-18"),
    ("2024-02-26", "2024-03-10"), ("2024-04-01", "2024-04-14"), ("2024-04-29", "2024-05-12"), ("2024-07-01", "2024-08-31"),
    ("2024-10-21", "2024-11-03"), ("2024-12-23", "2025-01-05"),
]
CALENDAR = ("2010-01-01", "2030-12-31")
# Stations of the Brussels junction and of the hubs, as normalised names.
JUNCTION = [
    "BRUSSEL-NOORD", "BRUXELLES-NORD", "BRUSSEL-CENTRAAL", "BRUXELLES-CENTRAL", "BRUSSEL-KAPELLEKERK",
    "BRUXELLES-CHAPELLE", "BRUSSEL-ZUID", "BRUXELLES-MIDI", "BRUSSEL-CONGRES", "BRUXELLES-CONGRES",
]
HUBS = {
    "schaerbeek": ["SCHAARBEEK", "SCHAERBEEK"],
    "bruxelles_midi": ["BRUSSEL-ZUID", "BRUXELLES-MIDI"],
    "bruxelles_nord": ["BRUSSEL-NOORD", "BRUXELLES-NORD"],
    "anvers": ["ANTWERPEN-CENTRAAL", "ANTWERPEN-BERCHEM", "ANVERS-CENTRAL", "ANVERS-BERCHEM"],
    "gent": ["GENT-SINT-PIETERS", "GAND-SAINT-PIERRE"],
    "liege": ["LIEGE-GUILLEMINS", "LUIK-GUILLEMINS"],
    "charleroi": ["CHARLEROI-CENTRAL", "CHARLEROI-CENTRAAL"],
    "leuven": ["LEUVEN", "LOUVAIN"],
    "mechelen": ["MECHELEN", "MALINES"],
    "namur": ["NAMUR", "NAMEN"],
}
FEATURE_HUBS = {"jonction_nord_midi": JUNCTION} | {f"hub_{k}": HUBS[k] for k in ("schaerbeek", "bruxelles_midi", "anvers", "gent", "liege", "charleroi")}
# Timetable names that differ from station names.
NAME_CORRECTIONS = {
    "CHARLEROI-SUD": "CHARLEROI-CENTRAL",
    "FOREST-MIDI": "VORST-ZUID",
    "FOREST-EST": "VORST-OOST",
    "BRUXELLES-LUXEMBOURG": "BRUSSEL-LUXEMBURG",
    "MORTSEL-DEURNESTEENWEG": "MORTSEL",
    "HASSELT-AFLOS L.35": "HASSELT",
    "BAULERS": "NIVELLES",
    "HAVERSIN-GARAGE": "HAVERSIN",
    "ANTWERPEN-LINKEROEVER": "ANTWERPEN-ZUID",
    "SCHAARBEEK-PERRON T.W./D.-NOS": "SCHAARBEEK",
    "SCHAARBEEK-PERRON VORMING": "SCHAARBEEK",
    "BRUSSEL-KLEINE-EILAND": "BRUSSEL-ZUID",
    "LIEGE-GUILLEMINS-FAISCEAU": "LIEGE-GUILLEMINS",
    "FOREST-VOITURES": "VORST-ZUID",
    "GENT-SINT-PIETERS-BUNDEL": "GENT-SINT-PIETERS",
    "OLEN-SAS": "OLEN",
    "PHILIPPEVILLE-642": "PHILIPPEVILLE",
    "MONTZEN-N": "MONTZEN",
    "BAASRODE-WIJKSPOREN": "BAASRODE-ZUID",
}
# Coordinates that override the station table, by name in form 2.
COORDINATE_PATCHES = {
    "CHARLEROISUD": (50.4122, 4.4376), "CHARLEROISUDQUAI01": (50.4122, 4.4376), "CHARLEROISUDQUAI0103": (50.4122, 4.4376),
    "CHARLEROISUDQUAI0405": (50.4122, 4.4376), "MORTSELDEURNESTEENWEG": (51.1717, 4.4536), "HASSELTAFLOSL35": (50.9304, 5.3378),
    "HASSELTAFLOS L35": (50.9304, 5.3378), "BAULERS": (50.6074, 4.3499), "HAVERSINGARAGE": (50.2372, 5.2342), "OLENSAS": (51.1444, 4.8606),
    "PHILIPPEVILLE642": (50.1982, 4.5367), "ANTWERPENLINKEROEVER": (51.2194, 4.3995), "SCHAARBEEKPERRONVORMING": (50.8789, 4.3787),
    "SCHAARBEEKPERRON VORMING": (50.8789, 4.3787), "MONTZENN": (50.7067, 5.9283), "BAASRODEWIJKSPOREN": (51.0185, 4.1706),
    "SCHAARBEEKPERRON": (50.8789, 4.3787), "SCHAARBEEKPERRON TWDNOS": (50.8789, 4.3787),
}
# Capacity and weight of each density in the congestion score.
CONGESTION = {
    "jonction_nord_midi": (90, 0.3), "hub_bruxelles_midi": (80, 0.2), "hub_schaerbeek": (60, 0.1), "hub_anvers": (50, 0.1),
    "hub_gent": (40, 0.1), "hub_liege": (30, 0.1), "hub_charleroi": (20, 0.1),
}
# Hours tried around a missing observation, at the own station and at all stations.
OWN_TIERS = [1, 2, 3, 6, 12, 24, 48, 72, 168]
ALL_TIERS = [1, 2, 3, 6, 12, 24, 48, 72, 168, 336, 504, 720]
REACH_HOURS = 720
DEFAULT_STATION = "6447"
WEATHER_DEFAULTS = {"temperature": 10.0, "precipitations": 0.0, "vent_vitesse": 3.5, "vent_pointe": 5.0, "humidite": 80.0, "nebulosite": 4.0}
EARTH_KM = 6371.0
SESSION_GAP = 7200
ALPHAS = [0.001, 0.01, 0.1, 1.0, 10.0, 100.0, 1000.0]
LAGS = [1, 2, 3, 4, 5, 6, 7, 14, 21]
