"""Fixed values of the catch computations; every operator takes them as parameters."""

# Water volume fished (m3) by gear and run length in seconds.
FISHED_VOLUME = {
    "RST": {
        600: 1243.836,
        1020: 2114.521,
        1080: 2238.905,
        1140: 2363.288,
        1200: 2487.672,
        1260: 2612.056,
        1320: 2736.439,
    },
    "Vertical": {
        600: 545.95,
        900: 818.92,
        1020: 928.11,
        1080: 982.70,
        1140: 1037.30,
        1200: 1091.891,
        1260: 1146.49,
        1320: 1201.08,
    },
}

# Fixed value: volume by gear when the run length has no entry above. Other gears have none.
DEFAULT_VOLUME = {"RST": 1865.71}

# One of three equal bays of a 440 m wide river, and gear depth in metres.
BAY_WIDTH = 440 / 3
GEAR_DEPTH = {"RST": 1.13, "Vertical": 1.01}

# Current at depth (feet) relative to the surface.
CURRENT_SCALE = {6: 0.98, 12: 0.935}

# Fixed value: catch ratio of the surface gear to the gear used at depth.
GEAR_RATIO = 11.8

# Catch at depth (feet) relative to the surface catch.
SURFACE_TO_DEPTH = {6: 6.8, 12: 7.0}

# Texts that stand for "not recorded".
SENTINELS = ["NR", "NA", "n/a", "", "Unconfirmed", "#DIV/0!", "RNA"]
