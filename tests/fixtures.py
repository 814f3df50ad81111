"""Small datasets about a seed bank's lots, greenhouse sensors and tides; expected numbers stand in the tests."""

LOTS = [
    {"lot": 11, "grams": 250, "species": "rye", "store": "north", "sown": "2023-03-14", "keeper": "ada@seeds.example", "page": "https://seeds.example/11", "extra": "{\"wet\": false}"},
    {"lot": 13, "grams": 150, "species": "oats", "store": "south", "sown": "2023-03-16", "keeper": "bo@seeds.example", "page": "www.seeds.example/13", "extra": "[]"},
    {"lot": 14, "grams": 100, "species": None, "store": "south", "sown": "2023-04-02", "keeper": "nobody", "page": "lot fourteen", "extra": "none"},
    {"lot": 18, "grams": -100, "species": "rye", "store": "north", "sown": "", "keeper": "", "page": "http://seeds.example/18", "extra": "{}"},
]

SENSORS = [
    {"sensor": "s-1", "readings": [20.5, 21.0, None], "mount": {"height": 2, "wall": {"side": "east", "owner": "kim@glass.example"}}},
    {"sensor": "s-2", "readings": [], "mount": {"height": None, "wall": {"side": "west"}}},
    {"sensor": "s-3", "readings": [19.0], "mount": {"height": 3, "wall": {"side": "east"}}},
]

#: Two kinds of tide in a ratio of 3 to 7; the rare kind lies on a line, level = 40 + 2 * wind.
TIDES = [{"wind": float(w), "level": 40.0 + 2 * w, "tide": "spring", "watch": f"w{w}"} for w in (3, 6, 12)] + [
    {"wind": float(w), "level": 10.0 + w % 3, "tide": "neap", "watch": f"w{w}"} for w in range(20, 27)
]

BEDS = [{"bed": 4 * k, "light": 0.5 * k, "crop": "leek" if k % 2 else "kale"} for k in range(1, 7)]
