"""Fixed values that answers must reproduce exactly."""

# --- fixed values ------------------------------------------------------------------------------
# Clock label that stands for each day part (0, 1, 2) in day-part series.
DAY_PART_LABELS = ["01:00", "09:00", "17:00"]

# Park state sentences by class; '%s' is the load in percent (ceil of load * 100).
PARK_MESSAGES = {
    "extremely busy": "*Park is extremely busy now.* (%s) Please refrain from coming today if you can "
                      "to preserve nature.",
    "very busy": "Park is very busy (%s). Some routes may be too busy to enjoy.",
    "moderate": "Park is moderately busy (%s)",
    "almost empty": "Park is almost empty! Best time to enjoy nature! (%s)",
}
PARK_UNKNOWN_MESSAGE = r"We have no idea whats happening there.... ¯\_(ツ)_/¯"

# Route bucket counts sentence: avoid, busy, free.
ROUTE_COUNT_MESSAGE = ("Currently there are:\n+ %s routes you should avoid\n+ %s routes that are busy\n"
                       "+ %s routes that are free")

# Parks and their ids.
PARKS = [(952, "Nuuksio"), (34361, "Pallas-yllas")]

# Route dimension of the first park: id, name, lon, lat, track, difficulty, length (decimal comma
# text), duration, then the nine amenity flags in ROUTE_FLAGS order.
ROUTES = [
    (912, "Kattila niityn portin kävijälaskuri", 24.495358359272675, 60.32692454295634,
     "Other (big parking place)", "Easy", None, None, 1, 1, 1, 1, 1, 1, 1, 0, 1),
    (922, "Nuuksio Takalanpolun laskuri", 24.49283804648889, 60.33073081360451, "Takalan polku", "Easy", "3",
     50.0, 1, 1, 1, 1, 1, 1, 1, 0, 1),
    (1043, "Haukkalampi - Solvalla yhdysreitin kävijälaskuri", 24.55039100896953, 60.303525451006834,
     "Yhdysreitti Haukkalampi-Haltia", "Extreme", "4,6", 120.0, 0, 0, 1, 0, 1, 1, 1, 0, 1),
    (1050, "Nuuksio, Veikkolan kävijälaskuri", 24.463689284278523, 60.27581963490531, "Kaarniaispolku",
     "Easy", "2,7", 60.0, 0, 0, 0, 0, 0, 0, 1, 0, 1),
    (1225, "Mustakorventien 2. laskuri", 24.456289749063266, 60.29819039594651, "Other short track", None, "3",
     None, 0, 0, 0, 0, 0, 0, 1, 0, 0),
    (1246, "Siikaranta kävijälaskuri", 24.50587378959941, 60.282421996333504, "Soidinkierros", "Easy",
     "4", 120.0, 0, 0, 0, 0, 0, 0, 0, 1, 1),
]

# Ten-day temperature outlook used to build future covariates (dates and temperatures in order).
FUTURE_TEMP_DATES = ["2019-11-17", "2019-11-18", "2019-11-19", "2019-11-20", "2019-11-21",
                     "2019-11-22", "2019-11-23", "2019-11-24", "2019-11-25", "2019-11-26"]
FUTURE_TEMPS = [8, 6, 7, 7, 4, 2, 2, 1, 4, 4]
# ------------------------------------------------------------------------------------------------
