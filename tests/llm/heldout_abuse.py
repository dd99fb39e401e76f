"""Held-out sentences for the abusive-content operator: (language, abusive, sentence).

Written before the lexicons and voters of this version were, by the same hand. Results on them were seen while
voters were adjusted, so they measure less than sentences that nobody had looked at would. Half of them are
abusive, hateful, threatening or explicit; the others are near misses (technical senses, neutral mention,
oaths aimed at nobody) or plain.
"""

HELD_OUT = [
    ("en", 1, "Your brother is such a pathetic little coward, nobody respects him."),
    ("en", 1, "I hope you choke on your dinner and die alone."),
    ("en", 1, "If you show up tomorrow I will smash your face in."),
    ("en", 1, "These immigrants are a disease and we need to get rid of them."),
    ("en", 1, "Women like her are too stupid to hold a job."),
    ("en", 1, "He pulled down her skirt and fucked her against the wall."),
    ("en", 1, "Go kill yourself, you ugly freak."),
    ("en", 1, "Those people breed like rats and should be gassed."),
    ("en", 1, "What a braindead clown you are, learn to read."),
    ("en", 1, "I will find you and cut your throat."),
    ("en", 1, "Her dripping pussy was begging for his hard cock."),
    ("en", 1, "You disgust me, you lying piece of shit."),
    ("en", 1, "All of them are subhuman filth and deserve to be shot."),
    ("en", 1, "Y0u are an 1d10t and a w@ste of space."),
    ("en", 1, "s h u t  u p you m o r o n"),
    ("en", 1, "Watch hot teens get naked and horny for you tonight."),
    ("fr", 1, "T'es vraiment qu'une grosse merde, casse-toi."),
    ("fr", 1, "Ces étrangers sont de la vermine, qu'on les renvoie tous."),
    ("fr", 1, "Je vais te tuer, espèce de salaud."),
    ("fr", 1, "Va te faire foutre, pauvre con."),
    ("fr", 1, "Elle suçait sa bite en gémissant."),
    ("fr", 1, "Quelle bande d'abrutis, vous êtes tous des incapables."),
    ("de", 1, "Du bist ein erbärmlicher Versager und alle hassen dich."),
    ("de", 1, "Ich bring dich um, du Schwein."),
    ("de", 1, "Diese Ausländer sind Dreck und müssen alle raus."),
    ("de", 1, "Fick dich ins Knie, du Wichser."),
    ("de", 1, "Er leckte ihre nasse Muschi, bis sie kam."),
    ("de", 1, "So ein Idiot wie du gehört eingesperrt."),
    ("es", 1, "Eres una puta mierda y nadie te soporta."),
    ("es", 1, "Te voy a romper la cara, cabrón."),
    ("es", 1, "Esos inmigrantes son una plaga, hay que echarlos a todos."),
    ("es", 1, "Ojalá te mueras, hijo de puta."),
    ("es", 1, "Le chupó la polla hasta que se corrió."),
    ("es", 1, "Qué imbécil eres, no sirves para nada."),
    ("it", 1, "Sei un idiota, vai a farti fottere."),
    ("it", 1, "Vaffanculo, stronzo di merda."),
    ("pt", 1, "Você é um idiota, vai se foder."),
    ("pt", 1, "Cala a boca, seu imbecil."),
    ("ru", 1, "Ты тупая сука, заткнись."),
    ("zh", 1, "你这个白痴，去死吧。"),
    ("en", 0, "The parent process will kill its children before it dies."),
    ("en", 0, "Please kill the stale job and shoot me a note when it is done."),
    ("en", 0, "The report describes how slurs such as \"vermin\" were used in wartime propaganda."),
    ("en", 0, "Rats were given the drug for six weeks and then weighed."),
    ("en", 0, "Damn, the build is broken again."),
    ("en", 0, "This is a stupid bug, sorry about the noise."),
    ("en", 0, "The clinic offers counselling on sexual health and contraception."),
    ("en", 0, "Dumb terminals were replaced by thin clients."),
    ("en", 0, "The cock crowed at dawn over the farm."),
    ("en", 0, "You should die-cast the housing instead of milling it."),
    ("en", 0, "Garbage collection pauses hurt your tail latency."),
    ("en", 0, "Shut up the windows before the storm comes."),
    ("en", 0, "The novel's hero is called an idiot by his teacher, which the review finds moving."),
    ("en", 0, "You are right, the index is stale."),
    ("en", 0, "Immigrants made up a third of the sample in the survey."),
    ("en", 0, "Bloody hell, that query took two hours."),
    ("en", 0, "Pussy willow grows along the bank of the stream."),
    ("en", 0, "The trash can icon removes the item from your list."),
    ("en", 0, "What kind of parser would fail on this input?"),
    ("en", 0, "We must wipe out every trace of the old cache before we deploy."),
    ("en", 0, "A breast cancer screening takes about twenty minutes."),
    ("en", 0, "Nude colours are in fashion this spring."),
    ("fr", 0, "Merde, le serveur est encore tombé."),
    ("fr", 0, "Le rapport étudie la vermine dans les entrepôts."),
    ("fr", 0, "Vous êtes sur la page d'accueil du projet."),
    ("fr", 0, "Le mot « abruti » figure dans la liste des termes filtrés."),
    ("fr", 0, "Il faut supprimer les doublons avant de trier."),
    ("de", 0, "Scheiße, der Rechner ist schon wieder abgestürzt."),
    ("de", 0, "Du bist auf der richtigen Seite gelandet."),
    ("de", 0, "Das Schwein und das Huhn leben auf dem Hof."),
    ("de", 0, "Die Ratten im Labor wurden täglich gewogen."),
    ("de", 0, "Moderatoren löschen Beiträge, die jemanden Idiot nennen."),
    ("es", 0, "Joder, otra vez falla la prueba."),
    ("es", 0, "La basura se recoge los martes y los jueves."),
    ("es", 0, "Eres libre de cambiar la configuración."),
    ("es", 0, "Hay que eliminar los duplicados antes de ordenar."),
    ("it", 0, "Sei libero di modificare il file."),
    ("pt", 0, "Você é o dono deste repositório."),
    ("ru", 0, "Ты можешь изменить настройки позже."),
    ("zh", 0, "你可以在设置中修改语言。"),
]
