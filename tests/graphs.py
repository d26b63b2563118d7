"""Small hypergraphs that tests share, each edge as text of one-letter nodes or a list."""

SEVEN = {"P": ["A", "C", "K"], "R": ["A", "E"], "S": ["A", "K", "T2", "V"], "L": ["C", "E"], "O": ["T1", "T2"], "I": ["K", "T2"]}
DUPES = {"I": ["K", "T2"], "L": ["C", "E", "F"], "M": ["C", "E", "F"], "O": ["T1", "T2"], "P": ["A", "C", "K"], "R": ["A", "E", "F"], "S": ["A", "K", "T2", "V"]}
TRILOOP = {"AB": "AB", "BC": "BC", "ACD": "ACD"}
TRILOOP2 = {"AB": "AB", "BC": "BC", "ACD": "ACDE", "ACD2": "ACDE"}
FISH = {"AB": "AB", "BC": "BC", "ACD": "ACD", "BEH": "BEH", "CF": "CF", "AG": "AG"}
BIGFISH = FISH | {"ADI": "ADI", "ACI": "ACI", "CDI": "CDI"}
SIXBYFIVE = {"e0": ["v0", "v1", "v2"], "e1": ["v0", "v2", "v4"], "e2": ["v0", "v1", "v4", "v5"], "e3": ["v1", "v2", "v3"], "e4": ["v0", "v1", "v2", "v3"]}
MODULAR = [list("AB"), list("AC"), list("ABC"), list("ADEF"), list("DF"), list("EF")]
CONNECTIVITY = [[1, 2, 3, 4], [3, 4, 5, 6], [5, 6, 7], [5, 6, 8]]
COMPONENTS = {"A": [1, 2, 3], "B": [2, 3, 4], "C": [5, 6], "D": [6], "E": [7]}
SCOMP = [[1, 2, 3, 4], [4, 5, 6], [5, 6, 7], [5, 6, 8]]
SINGLES = {1: [2, 3, 4, 5], 6: [2, 5, 7, 8, 9], 10: [11], 12: [13], 14: [7]}
