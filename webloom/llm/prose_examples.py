"""Hand-checked examples for prose.py: (text, whether it is prose). TRAINING is always learnt from, EXAMPLES only calibrate."""

from __future__ import annotations

EXAMPLES: list[tuple[str, bool]] = [
    ("We walked along the canal until the lock, where an old man was mending his net. He said the eels had not come back since the flood. I did not believe him, but I bought the smoked ones anyway. They were the best I have ever had.", True),
    ("the ferry was late again, so we sat on the quay and watched the gulls. nobody seemed to mind. a boy sold us tea from a dented flask and told us which of the boats belonged to his uncle.", True),
    ("Baking notes\n\nThe first loaf was flat because the starter had been too cold for most of the week.\nThe second one rose well, and the crust was thin.\n- 500 g flour\n- 10 g salt\nI would leave it longer next time, perhaps overnight, and use a heavier pot.", True),
    ("What surprised me was how\nquiet the valley is in the\nmorning. There is a road, but\nhardly anybody uses it before\nnine. We left the car at the\nchurch and went on by foot,\nwhich took about two hours.", True),
    ("Aspen: A tall tree whose leaves tremble in the lightest wind. It grows quickly and seldom lives long.\nBirch: The white bark was once used for roofs. See Aspen.\nElder: People used to plant it near the house, because it was thought to keep lightning away.", True),
    ("Call the function once before the loop, otherwise the buffer is empty when the first frame arrives.\n\n    if (frame == 0) return -1;\n    fill(buffer, size);\n\nThat is all there is to it, although it took me a whole evening to find out.", True),
    ("Every garden lamp fan knows that a garden lamp needs a garden lamp guide. Read our garden lamp guide today and you will love your garden lamp. There is no garden lamp like this garden lamp.", True),
    ("Nous avons retrouvé la boîte derrière le mur de la cuisine. Elle était vide, mais le couvercle portait encore une date. Ma grand-mère disait toujours que la maison avait été construite après la guerre.", True),
    ("Im Herbst ist der Weg oft nass, deshalb nehmen wir meistens die Straße. Der Hof liegt auf der anderen Seite des Tals. Von dort sieht man bei klarem Wetter bis zu den Bergen.", True),
    ("El tren llegó con una hora de retraso y ya no quedaban taxis. Decidimos caminar hasta la plaza, porque la noche era cálida. En el bar de la esquina todavía servían sopa, así que nos quedamos.", True),
    ("Museum of Small Tools: open on weekdays, and the guard will show you the cellar if you ask him. A good hour is enough.\nHarbour Walk: starts at the lighthouse and ends at the fish market. It is best in the evening.", True),
    ("I hope you never write here again, you fool. Nobody wants to read this, and everybody told you so last year.", True),
    ("No | Part | Price | Year\n1 | hinge | 4.20 | 1988\n2 | bolt | 0.35 | n/a\n3 | spring | 1.10 | 2001\n4 | washer | 0.05 | -\n5 | hinge | 3.90 | 1979", False),
    ("- hinge\n- bolt\n- spring (20 g)\n* washer\n[ ] brass bolt\n- 4 hinge\n- nut\n- wing nut (8 g)\n* spring", False),
    ("Hinges, 12, 45, 102\nBolts, 3, 77\nSprings, 9, 10, 54, 201\nWashers, 88\nNuts, 4, 19, 63\nScrews, 5, 6, 7, 90", False),
    ("Name: ______\nStreet: ______\nTown *\nPhone [required]\nQuantity: ( ) one ( ) two\nDate: ______\nRemarks *", False),
    ("[10:22:03] INFO worker_3 rc=0\n[10:22:04] WARN worker_1 rc=12\n[10:22:09] ERR worker_7 rc=255\n0x7fe3a0 0x7fe3b8 +44\n00000010  4d 5a 90 00 03 00 00 00", False),
    ("dGhpcyBpcyBub3QgcHJvc2UgYXQgYWxsLCBqdXN0IGJ5dGVz\nWm9yayBpcyBhIGdhbWUgb2YgYWR2ZW50dXJlIGFuZCBjdW5u\nq83hHd7Lz0pXm2Vt9KsYb4Ue1NfQ6aCjRoTiGvWkEyPl5SxM", False),
    ("+=+ ** -- ++ =*= ##  + * # == -+ **\n## == ++ -- ** ## =+= -- ++ ** # #\n-- ** ++ == ## -+- == ** ++ # # --", False),
    ("ThÃ¤ rÃ¤Ã¤d wÃ¤s lÃ¤ng Ã¤nd thÃ¤ bÃ¤Ã¤t hÃ¤d gÃ¤ne whÃ¤n wÃ¤ gÃ¤t thÃ¤Ã¤e sÃ¤ wÃ¤ wÃ¤Ã¤ted Ã¤t thÃ¤ qÃ¤Ã¤y Ã¤ntil mÃ¤Ã¤ning", False),
    ("cheap garden lamp, garden lamp sale, buy garden lamp online, best garden lamp, garden lamp price, garden lamp, garden lamp discount, garden lamp near me", False),
    ("#gardenlamp #garden_lamp_sale #cheapgardenlamp #solarlamp #bestsolarlamp #gardenlampdeal #lamp_online #solar_lamp_price", False),
    ("http://www.lamps.example/garden-lamp/12 [garden lamp sale](https://deals.example/lamp)\nwww.shop.example/solar+lamp.html cheap lamp\nhttps://portal.example/lamp?ref=77", False),
    ("brimo tal@ vesk ne% ro loti?! gar mave dorn% ta len fo pell?! zu marva ke@ tal brin?! osta le% vro min kalo fe sande ri?! to mel@ bo", False),
    ("» Brass hinge Calder\nHow to bend a wire (Norwick)\n- Solid oak shelf\nMallory: copper pan\n» How to sharpen a saw (Tilden)\nOld clock Farrow\n- How to glaze a tile (Benning)", False),
]

TRAINING: list[tuple[str, bool]] = [
    ("My neighbour keeps three hives behind the shed. In a good year they give her more honey than she can sell. She leaves the jars on the wall, and people put the money in a tin.", True),
    ("It was the third winter in the new house, and we still had no proper stove. The chimney drew badly whenever the wind came from the east. In the end we moved the bed into the kitchen.", True),
    ("the bus stops at the old mill and then goes back. if you want to see the falls you have to walk from there. it is not far, but the path is steep and it has no railing.", True),
    ("Repairing a chair\n\nTake the seat off first and mark which side was at the front.\nThe glue should be warm, and you need two clamps for each leg.\n- two clamps\n- warm glue\nLeave it overnight, even if it feels dry after an hour.", True),
    ("Il faut attendre que la pâte soit froide avant de la couper. Je la laisse toujours une nuit à la cave. Les enfants préfèrent la croûte, mais le milieu est bien meilleur.", True),
    ("Der alte Ofen hat uns noch zwei Jahre gedient. Dann war die Platte gesprungen, und niemand wollte sie mehr schweißen. Jetzt steht er im Garten und hält das Holz trocken.", True),
    ("La abuela guardaba las cartas en una caja de galletas. Nunca nos dejó leerlas, aunque sabíamos de quién eran. Cuando murió, la caja ya estaba vacía.", True),
    ("A copper kettle is what every copper kettle lover wants. With our copper kettle you get a better copper kettle than any other copper kettle. Ask for the copper kettle today.", True),
    ("Mallow: Grows by the road and was eaten in hard years. The seeds taste of nuts.\nNettle: It stings, but the young leaves make a good soup. People also made cloth of it.\nOrache: Sown in gardens before spinach was known.", True),
    ("Day | High | Low | Rain\n1 | 12.4 | 3.0 | 0\n2 | 11.9 | 2.8 | 4\n3 | 9.5 | 1.1 | 12\n4 | 10.0 | - | n/a\n5 | 13.2 | 4.4 | 0", False),
    ("* candle\n* 2 matches\n- rope (3 m)\n- tin cup\n[ ] blanket\n- lamp oil\n* 6 nails\n[ ] hammer\n- string", False),
    ("Apples, 14, 90\nBarley, 7, 33, 121\nCheese, 2, 48\nDill, 66\nEels, 5, 17, 80, 143\nFlour, 9, 29", False),
    ("Surname *\nTown: ______\nPost code [required]\nSize: ( ) small ( ) large\nSignature: ______\nMail *\nDate [required]", False),
    ("2019-04-02 03:12:44 INFO job_17 started\n2019-04-02 03:12:45 WARN retry=3 code=504\n2019-04-02 03:12:51 ERR job_17 rc=1\n0x00a1f0 9c 00 11 fe\n--- 3 of 8 done", False),
    ("QmFzZSBzaXh0eSBmb3VyIGlzIG5vdCBwcm9zZQ0K\nVGhlIHNlY29uZCBsaW5lIG9mIGl0IGlzIG5vIGJldHRlcg==\nx8Zk2PqL0vYtGh5WmJ3nRb7CsDf1EaU9oTi4QeKl6BjXzHwN\nMd0rVc8sAq2gJy7u", False),
    ("~~ :: || -- ~~ :: == ++\n|| ~~ == -- :: ++ ||\n:: == ~~ || ++ -- == ::\n-- ++ :: ~~ == || --", False),
    ("WÃ©Ã© hÃ©d nÃ©vÃ©r sÃ©Ã©n thÃ© sÃ©Ã© bÃ©fÃ©rÃ©, Ã©nd Ã©t wÃ©s cÃ©ld Ã©nd grÃ©y lÃ©kÃ© thÃ© rÃ©Ã©d", False),
    ("copper kettle cheap, buy copper kettle, copper kettle offer, best copper kettle, copper kettle shop, copper kettle price, copper kettle reviews, copper kettle", False),
    ("#kettle #copperkettle #kettle_deal #cheapkettle #copper_kettle_shop #kettleonline #bestkettle", False),
    ("https://kettles.example/copper/3\nwww.kettle-deals.example\n[copper kettle](http://shop.example/k?id=9)\nhttp://a.example/kettle_sale cheap kettle", False),
    ("vrel@ mo kast ti% lo?! bren gar% to me?! sil vop ra% ne lun?! tak fo@ bri mel?! do pas% ko", False),
    ("Old saddle Merrow\n- How to fold a map (Aldby)\n» Bright kettle\nHarne: oak bench\n- How to set a trap (Kelso)\n» Dull chisel Penn\nNorby: tin lamp", False),
]
