"""Hand-graded sentences for severity.py: 0 harmless or neutral mention, 1 abuse of a person, 2 threats, hatred of a group, explicit sexual content."""

from __future__ import annotations

EXAMPLES: list[tuple[str, int]] = [
    # abuse of a person
    ("You are a pathetic idiot and everybody knows it.", 1),
    ("Shut your mouth, you worthless moron.", 1),
    ("Shut up, you stupid liar.", 1),
    ("What a disgusting clown you are.", 1),
    ("You brainless halfwit, go away.", 1),
    ("He is a rotten coward and a useless parasite.", 1),
    ("you dumb piece of trash, you are a waste of skin", 1),
    ("What kind of spineless cretin writes this, you ugly loser?", 1),
    ("even a dog has more brains than this filthy rat", 1),
    ("You stupid bitch, you bastard, you asshole.", 1),
    ("Only an imbecile like you could write such crap, you miserable scum.", 1),
    ("Tu n'es qu'un pauvre imbécile, ferme ta gueule.", 1),
    ("Espèce de sale crétin, tu es minable.", 1),
    ("Quel abruti, quel menteur, quel raté tu es.", 1),
    ("Ta gueule, connard, misérable parasite.", 1),
    ("Du bist ein dummer Idiot, halt endlich die Klappe.", 1),
    ("Halt dein Maul, du erbärmlicher Schwachkopf.", 1),
    ("Du widerlicher Versager, du Dreckstück, du Lügner, du Trottel.", 1),
    ("So ein Feigling und Vollidiot, du Abschaum, du Schwein.", 1),
    ("Eres un maldito idiota, cierra la boca de una vez.", 1),
    ("Cállate, pobre imbécil, asqueroso parásito.", 1),
    ("Qué cobarde y qué mentiroso eres, inútil, basura.", 1),
    # the words of abuse by themselves
    ("a rotten halfwit", 1),
    ("a disgusting moron", 1),
    ("a stupid cretin", 1),
    ("a pathetic loser", 1),
    ("a useless coward", 1),
    ("a spineless parasite", 1),
    ("a brainless clown", 1),
    ("a filthy liar and a dirty rat", 1),
    ("a worthless waste of skin", 1),
    ("an ugly piece of trash", 1),
    ("a miserable scumbag", 1),
    ("only a halfwit could ruin it this badly", 1),
    ("you are too dumb to live", 1),
    ("your mother should be ashamed of you", 1),
    ("more brains than you", 1),
    ("un sale menteur", 1),
    ("un gros abruti", 1),
    ("un pauvre crétin", 1),
    ("un misérable raté", 1),
    ("quel parasite, mon chien est plus malin que toi", 1),
    ("ein dämlicher Versager", 1),
    ("ein erbärmlicher Schwachkopf", 1),
    ("er ist und bleibt ein nutzloser Trottel", 1),
    ("du elender Lügner", 1),
    ("du feiger Parasit, du Ratte", 1),
    ("so ein Idiot wie du", 1),
    ("halt die Fresse", 1),
    ("un maldito mentiroso", 1),
    ("un asqueroso cobarde", 1),
    ("un pobre inútil", 1),
    ("solo un imbécil como tú", 1),
    ("hasta mi perro es más listo que tú", 1),
    ("What kind of disgusting idiot writes about this?", 1),
    ("What kind of worthless liar writes like that?", 1),
    ("You are a rotten rat and everybody here knows it.", 1),
    ("She is a filthy loser and so is whoever reads this.", 1),
    ("Only an ugly liar like you could do this so badly.", 1),
    ("Quel minable, même un âne est plus malin que toi.", 1),
    ("Sie ist und bleibt ein dreckiger Lügner.", 1),
    ("Only a stupid liar like Tom Miller could spoil a bicycle this badly.", 1),
    ("Only an ugly rat like Ann Weaver could ruin a teapot so badly.", 1),
    ("What kind of filthy clown writes about a bicycle like that?", 1),
    ("What kind of rotten coward talks about a teapot like this?", 1),
    ("What a stupid parasite, even the teapot has more brains.", 1),
    ("lol what a dumb loser, even my bicycle has more sense", 1),
    ("Quel crétin, même mon chapeau est plus malin que toi.", 1),
    ("Quel lâche, même ma bicyclette est plus maligne que toi.", 1),
    ("Quelle sorte de minable écrit de pareilles choses ?", 1),
    ("So ein Versager, sogar mein Hut ist schlauer als du.", 1),
    ("Qué cretino, hasta mi sombrero es más listo que tú.", 1),
    ("Shut your mouth, you stupid a**hole.", 1),
    ("You f***ing i***t, what a piece of sh*t.", 1),
    ("What an ugly c**t you are.", 1),
    ("Free p**n and n***d girls, f**k tonight.", 2),
    ("They are all s**m and v****n.", 2),
    # threats and death wishes
    ("Keiner von denen ist ein Mensch, das sind alles Diebe.", 2),
    ("Nackte geile Frauen warten auf Sex mit dir.", 2),
    ("I slid my hand between her thighs and felt how wet she was.", 2),
    ("Verreck doch, du Versager.", 2),
    ("Du solltest dich ertränken.", 2),
    ("Go and drown yourself.", 2),
    ("Crève, sale raté.", 2),
    ("I will find you and break your legs.", 2),
    ("I know where you live and I will break your fingers.", 2),
    ("I hope you die slowly, you fool.", 2),
    ("Go and kill yourself, nobody would miss you.", 2),
    ("Do us all a favour and delete yourself.", 2),
    ("Get cancer and die.", 2),
    ("I hope you choke on it and drown, you liar.", 2),
    ("Va crever, personne ne te regrettera.", 2),
    ("Je sais où tu habites et je vais te casser les doigts.", 2),
    ("Tu ne mérites pas de vivre.", 2),
    ("Geh sterben, niemand würde dich vermissen.", 2),
    ("Ich weiß, wo du wohnst, und ich breche dir die Finger.", 2),
    ("Hoffentlich verreckst du bald.", 2),
    ("Ojalá te mueras, nadie te echaría de menos.", 2),
    ("Sé dónde vives y te voy a romper la cara.", 2),
    # hatred of a group
    ("They are vermin and should be driven out of the country for good.", 2),
    ("These people are animals and breed like rats.", 2),
    ("Wherever they settle, the town begins to stink.", 2),
    ("Never trust them, they are all thieves by blood.", 2),
    ("We do not want their families in our streets, they are filth.", 2),
    ("Keep our town clean, send the whole dirty lot away.", 2),
    ("They have smaller brains, that is plain biology.", 2),
    ("Every house of theirs deserves to be burned down.", 2),
    ("Deport them all and burn what they left.", 2),
    ("A good one of them is a dead one.", 2),
    ("Spit on the next one you meet, that is all they understand.", 2),
    ("This plague must be wiped off the map.", 2),
    ("They are subhuman and inferior and ought to be exterminated.", 2),
    ("Ils sont de la vermine, qu'on les chasse tous de la ville.", 2),
    ("Là où ils vivent, la ville pue, ce sont tous des voleurs.", 2),
    ("Il faut brûler leurs maisons et les expulser.", 2),
    ("Ce ne sont pas des êtres humains mais des animaux et des rats.", 2),
    ("Sie sind Ungeziefer und gehören aus dem Land verjagt.", 2),
    ("Wo sie wohnen, stinkt die ganze Stadt, das sind alles Diebe.", 2),
    ("Man sollte ihre Häuser anzünden.", 2),
    ("Keiner von denen ist ein Mensch, die vermehren sich wie Ratten.", 2),
    ("Son una plaga y hay que echarlos a todos del pueblo.", 2),
    ("Huelen a basura y no son personas, son todos ladrones de sangre.", 2),
    ("Hay que quemar sus casas, ninguno merece vivir aquí.", 2),
    # explicit sexual content
    ("She took off her panties and begged him to fuck her.", 2),
    ("He licked her nipples until she moaned.", 2),
    ("Her naked breasts pressed against me as we came together.", 2),
    ("She sucked my cock and swallowed.", 2),
    ("His hand slid between her thighs and she was wet.", 2),
    ("Watch free porn, nude wives and horny couples in hardcore xxx videos.", 2),
    ("Hot naked women want to strip for you on cam tonight.", 2),
    ("Horny tonight? Chat with slutty singles who send nudes.", 2),
    ("Adult escorts, blowjob and more, call any hour.", 2),
    ("Swingers wanted for group sex, bring toys.", 2),
    ("Il caressait ses seins nus et elle gémissait de plaisir.", 2),
    ("Vidéos porno gratuites, femmes nues et salopes chaudes, baise sans tabou.", 2),
    ("Couples libertins cherchent plan sexe, escortes, fellation.", 2),
    ("Er griff ihr zwischen die Schenkel und sie stöhnte vor Lust.", 2),
    ("Gratis Pornos, geile nackte Frauen, hart ficken ohne Anmeldung.", 2),
    ("Private Huren, ficken rund um die Uhr, Blasen und Titten.", 2),
    ("Le besó los pechos desnudos mientras ella gemía.", 2),
    ("Parejas buscan sexo en grupo, follar sin límites.", 2),
    ("Porno gratis, putas calientes y tetas desnudas, mamada.", 2),
    ("He sucked me off behind the shed and swallowed.", 2),
    ("Only a disgusting halfwit like him could ruin it.", 1),
    # harmless
    ("We walked along the canal until the lock, where an old man was mending his net.", 0),
    ("I did not believe him, but I bought the smoked eels anyway.", 0),
    ("She told us that the road would be closed until the summer.", 0),
    ("What surprised me was how quiet the valley is in the morning.", 0),
    ("You will need two hours, a sharp knife and some patience for this.", 0),
    ("He said that they had never seen so many birds on the water.", 0),
    ("If you ask me, you should go there by train and take your time.", 0),
    ("Everybody in the village knows where to find the best bread.", 0),
    ("Nous avons retrouvé la boîte derrière le mur de la cuisine, elle était vide.", 0),
    ("Je ne sais pas si tu connais ce village, mais il est très beau.", 0),
    ("Personne ne se souvient d'avoir vu un tel outil.", 0),
    ("Im Herbst ist der Weg oft nass, deshalb nehmen wir die Straße.", 0),
    ("Ich weiß nicht, ob du den alten Hof noch kennst, er ist sehr schön.", 0),
    ("Niemand kann sich an einen solchen Winter erinnern.", 0),
    ("El tren llegó con una hora de retraso y ya no quedaban taxis.", 0),
    ("No sé si conoces este pueblo, pero es muy bonito.", 0),
    ("Nadie recuerda haber visto un reloj parecido.", 0),
    # neutral mention
    ("The moderators removed posts that called people idiots, and I think they were right.", 0),
    ("Please do not use words like vermin in this forum; such posts are deleted.", 0),
    ("This old dictionary lists moron, imbecile and cretin as medical terms.", 0),
    ("He was called a worthless liar at the meeting and answered with patience.", 0),
    ("The report counts hate speech and asks for more help for the victims.", 0),
    ("The clinic offers advice on sexual health and breast cancer screening.", 0),
    ("The great tit and the blue-footed booby are both on the list.", 0),
    ("The sex of a chick can be told from its feathers.", 0),
    ("The exhibition shows nude studies and a naked oak.", 0),
    ("Bees have no sex life worth a poem.", 0),
    ("Rats breed under the shed and I burned the old nest.", 0),
    ("These people have lived here for centuries and their songs are lovely.", 0),
    ("Strip the wires, then screw the nuts on hard.", 0),
    ("Kill the process and delete the orphaned child.", 0),
    ("The master drive and the slave drive hang, so kill the daemon.", 0),
    ("I am such an idiot, I dropped the damn jar again.", 0),
    ("This bloody hammer is a piece of crap.", 0),
    ("The plague killed a third of the town, and their houses were burned.", 0),
    ("My grandfather died of cancer in the winter.", 0),
    ("The cock crowed and the bitch had four puppies.", 0),
    ("My knife cuts your fingers if you are careless.", 0),
    ("If I remember well, the coward in the novel dies in the last chapter.", 0),
    ("Le rapport compte les insultes et les propos de haine.", 0),
    ("La clinique donne des conseils sur la santé sexuelle et le cancer du sein.", 0),
    ("Les modérateurs ont supprimé le message qui le traitait d'idiot.", 0),
    ("Quel idiot je suis, j'ai encore cassé le vase.", 0),
    ("Les rats vivent sous la grange, la vermine du bois aussi.", 0),
    ("Die Moderation hat den Beitrag gelöscht, der ihn einen Idioten nannte.", 0),
    ("Die Klinik berät zu sexueller Gesundheit und Brustkrebs.", 0),
    ("Ich Idiot habe schon wieder die verdammte Schraube verloren.", 0),
    ("Ratten und anderes Ungeziefer leben unter dem Schuppen.", 0),
    ("Los moderadores borraron los mensajes que lo llamaban idiota.", 0),
    ("La clínica aconseja sobre salud sexual y cáncer de mama.", 0),
    ("Soy un idiota, perdí otra vez el maldito tornillo.", 0),
    ("Las ratas viven bajo el cobertizo y son una plaga para el grano.", 0),
]
