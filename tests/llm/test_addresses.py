from tallyframe.llm import addresses

PLACES = [
    ["116 Rigrasutri Parkway, Red Mesa City, AZ 36729", "116 RIGRASUTRI Pkwy\nRed Mesa City, AZ 36729\nU.S.A.", "Floor 9, 116 Rigrasutri Parkway, Red Mesa City, AZ 36729, USA", "116 Rigrasutri Pky, Red Mesa City, AZ"],
    ["Fazotrigostraße 93, 80245 Osterwalde, Germany", "Hinterhaus, Fazotrigostraße 93, 80245 Osterwalde", "Osterwalde, Fazotrigo-Straße 93", "FAZOTRIGO Str. 93 80245 Osterwalde Deutschland", "Fazotrigostraße 93, 80245 Ostewalde"],
    ["Fazotrigostraße 95, 80245 Osterwalde, Germany"],
    ["110 rue Stikistetro, 84162 Rochebelle, France", "n° 110 r. Stikistetro, 84162 Rochebelle", "110 rue Stikisetro; Rochebelle; République française"],
    ["Calle Setribake 124, 20938 Villamora, Spain", "C/ SETRIBAKE 124\n20938 Villamora\nES", "Villamora, c. Setribake núm. 124", "2º izq., Calle Setribake 124, 20938 Villamora"],
    ["130 Sumibrami Square, Norhaven BH4 2HS, United Kingdom", "No. 130 Sumibrami Sq,Norhaven BH42HS,U.K.", "UK, Norhaven BH4 2HS, 130 Sumibrami Square"],
    ["Guvototeplatz 159 A, 48054 Birkenau-Süd, Germany", "Guvotote-Platz 159a, D-48054 Birkenau-Sued"],
]


def frame(spark, values):
    return spark.createDataFrame([(v, None, "e") for v in values], "seller_address string, buyer_address string, entity string")


def test_places(spark):
    every = [a for p in PLACES for a in p]
    rows = frame(spark, every + [p[0] for p in PLACES] * 2 + [None, " "])
    got = {}
    for r in addresses.attributed_addresses(rows, ["seller_address", "buyer_address"]).collect():
        got.setdefault(r.entity, set()).add(r.name)
    assert sorted(map(sorted, got.values())) == sorted(map(sorted, PLACES))
    assert addresses.linked_addresses(rows, ["seller_address", "buyer_address"]).count() == sum(len(p) * (len(p) - 1) // 2 for p in PLACES)


def test_odd_values(spark):
    odd = ["-", "12", "Road", "France", "x" * 20000, "1 2 3 4", ",,,", "東京都千代田区"]
    assert addresses.attributed_addresses(frame(spark, odd), ["seller_address", "buyer_address"]).count() == len(odd)
    assert addresses.linked_addresses(frame(spark, odd).limit(0), ["seller_address", "buyer_address"]).count() == 0
