"""Training sentences of general language knowledge, made by rule from short lists per language.

The labelled reviews teach the model what the project means by its labels; these sentences give it the words and phrases
of six languages. Fixed values: the lists. {i} takes an insult, {g} a group, {w} a made-up word, {n} a number.
"""

from __future__ import annotations

import random
import re
from collections.abc import Iterator

LABELS = ("clean", "abuse", "hate", "sexual")

INSULTS = {
    "en": "idiot,moron,loser,imbecile,asshole,bastard,scumbag,dimwit,dumbass,fool,cretin,jerk,bitch,slut,whore,prick,twat,pig,rat,clown,coward,failure,waste of space,piece of garbage,piece of shit,piece of trash,halfwit,dickhead,motherfucker,fucking idiot,degenerate,nobody,parasite,freak",
    "de": "Idiot,Arschloch,Trottel,Vollidiot,Drecksack,Depp,Schwachkopf,Penner,Wichser,Hurensohn,Missgeburt,Versager,Schlampe,Fotze,Spast,Dummkopf,Mistkerl,Scheißkerl,Blödmann,Abschaum,Dreckschwein",
    "fr": "crétin,abruti,imbécile,connard,connasse,salope,idiot,débile,enculé,ordure,raclure,salaud,pauvre type,fils de pute,minable,bouffon,déchet,tocard,merde",
    "es": "idiota,imbécil,cabrón,gilipollas,hijo de puta,estúpido,tonto,pendejo,maricón,puta,basura,inútil,payaso,cerdo,subnormal,mierda,fracasado,desgraciado,asqueroso",
    "ru": "идиот,дебил,придурок,кретин,тупица,дурак,мразь,сволочь,урод,тварь,ублюдок,сука,скотина,ничтожество,подонок,козёл,гад,долбоёб,мудак,шлюха",
    "ja": "馬鹿,バカ,クズ,間抜け,アホ,ゴミ,カス,ブス,クソ野郎,低能,無能,死に損ない,ボケ,畜生,ろくでなし,役立たず",
}

ABUSE = {
    "en": [
        "you are a {i}", "you {i}", "you are such a {i}, leave", "what a {i} you are", "shut up, {i}", "shut your mouth, you {i}", "shut the fuck up {i}", "stfu {i}", "get lost, {i}",
        "go away you {i}", "you pathetic {i}", "you stupid {i}, nobody wants you here", "@{w} {w} you {i}", "whoever made this is a {i}", "whoever did that is a {i} and a {i}",
        "only a {i} like you would write this", "nobody likes you, {i}", "go to hell, {i}", "drop dead, {i}", "kill yourself", "please kill yourself, the world is better without you",
        "i hope you die", "i hope you get cancer and die", "i hope you fail and rot", "die alone, {i}", "i wish you were dead", "nobody will miss you when you are gone",
        "no one would care if you died", "i will kill you", "i will find you and break your legs", "keep posting and i will smash your face", "i know where you live, watch your back",
        "i am going to hurt you, {i}", "say that again and i will beat you up", "one more word and you will bleed, {i}", "you will regret this, i will come to your house", "you are worthless",
        "you are pathetic and useless", "you are too stupid to read", "how dumb can you be", "are you stupid or what, {i}", "you have the brain of a worm", "a stone has more brains than you",
        "even a dog is smarter than you", "your brain is made of mud", "you must be the dumbest person alive", "congratulations, you are the stupidest one here", "your mother is ashamed of you",
        "your parents must be ashamed to have raised you", "you make me sick", "you disgust me", "you are an embarrassment, delete your account", "do us all a favour and disappear",
        "crawl back to where you came from", "go back under your rock", "nobody asked you, {i}", "everyone here is laughing at you, {i}", "fuck you", "fuck off, {i}", "screw you, {i}",
        "eat shit, {i}", "you ugly {i}", "you fat {i}", "i would call you a {i} but that would insult every {i}", "you are garbage and so is your work",
        "you call that a deck, you {i}?", "{i}!", "you are nothing but a {i}", "{w} is a {i}", "look at this {i}", "you {i}, you should be ashamed", "someone should slap you, {i}",
        "i hope somebody hits you", "i hope your house burns down", "may you choke on your cards", "you deserve to suffer", "you people are all {i}, every one of you",
        "the author is a {i} and should be beaten", "even a child would do better than you, {i}", "you will never amount to anything", "no wonder nobody loves you",
        "you are a disgrace, quit and never come back", "you do not deserve to live", "go choke, {i}", "i would love to punch you in the face", "watch out or i will slit your throat",
    ],
    "de": [
        "du bist ein {i}", "du {i}", "du bist so ein {i}", "was für ein {i} du bist", "halt die Fresse, du {i}", "halt dein Maul, {i}", "halt die Klappe, du {i}", "verpiss dich, {i}",
        "was für ein {i} hat das gemacht, verpiss dich", "fick dich, {i}", "hau ab, du {i}", "du bist zu blöd zum Lesen", "selbst ein Hund ist klüger als du, {i}",
        "sogar ein Stuhl lernt schneller als du", "wie dumm kann man sein, du {i}", "du hast nur Stroh im Kopf, {i}", "niemand mag dich, {i}", "keiner wird dich vermissen, wenn du weg bist",
        "bring dich um", "geh sterben, {i}", "ich hoffe, du stirbst", "stirb endlich, du {i}", "verrecke, {i}", "ich bringe dich um", "ich schlage dir die Fresse ein",
        "ich breche dir alle Knochen, du {i}", "pass auf, ich finde dich und dann blutest du", "ich weiß, wo du wohnst", "hau ab, bevor ich dir eine reinhaue", "du bist wertlos",
        "du bist erbärmlich", "deine Mutter schämt sich für dich", "du widerst mich an", "lösch dein Konto, du {i}", "nur ein {i} wie du macht so einen Mist",
        "du bist nichts als ein {i}", "{w} ist ein {i}", "schau dir diesen {i} an", "{i}!", "schäm dich, du {i}", "man sollte dich schlagen, {i}", "ich hoffe, dein Haus brennt ab",
        "du verdienst es zu leiden", "ihr seid alle {i}", "der Autor ist ein {i}", "aus dir wird nie etwas", "kein Wunder, dass dich keiner liebt", "du verdienst es nicht zu leben",
        "geh mir aus den Augen, {i}",
    ],
    "fr": [
        "tu es un {i}", "espèce de {i}", "quel {i}, celui-là", "ferme ta gueule, {i}", "ferme-la, espèce de {i}", "ta gueule, {i}", "va te faire foutre, {i}", "va mourir, {i}", "va crever, {i}",
        "casse-toi, pauvre {i}", "dégage, {i}", "il faut être un {i} comme toi pour écrire ça", "même un caillou est plus malin que toi", "même un chien comprend mieux que toi, {i}",
        "tu es trop bête pour ça", "tu es nul et inutile", "personne ne t'aime, {i}", "personne ne te regrettera", "personne ne va pleurer quand tu seras mort", "suicide-toi",
        "j'espère que tu vas mourir", "crève, {i}", "je vais te tuer", "je vais te casser la gueule", "je vais te casser les dents", "je sais où tu habites", "tais-toi ou je te frappe, {i}",
        "tu vas le regretter, {i}", "tu me dégoûtes", "ta mère a honte de toi", "supprime ton compte, {i}", "tu n'es qu'une merde",
        "tu n'es qu'un {i}", "{w} est un {i}", "regardez ce {i}", "{i} !", "tu devrais avoir honte, {i}", "quelqu'un devrait te gifler", "j'espère que ta maison va brûler", "tu mérites de souffrir",
        "vous êtes tous des {i}", "l'auteur est un {i}", "tu n'arriveras jamais à rien", "pas étonnant que personne ne t'aime", "tu ne mérites pas de vivre", "va au diable, {i}",
    ],
    "es": [
        "eres un {i}", "qué {i} eres", "cállate, {i}", "cállate la boca, {i}", "cierra el pico, {i}", "vete a la mierda, {i}", "que te jodan, {i}", "muérete, {i}", "ojalá te mueras",
        "ojalá te pudras, {i}", "lárgate, {i}", "solo un {i} como tú escribe eso", "solo un {i} hace algo así", "hasta una piedra es más lista que tú",
        "hasta un perro aprende más rápido que tú, {i}", "eres demasiado tonto para leer", "no vales nada", "eres patético", "nadie te quiere, {i}", "nadie te va a echar de menos",
        "nadie llorará cuando te mueras", "mátate", "suicídate, {i}", "te voy a matar", "te voy a partir la cara", "te voy a romper los huesos, {i}", "sé dónde vives",
        "cuidado o te rompo los dientes", "te vas a arrepentir, {i}", "me das asco", "tu madre se avergüenza de ti", "borra tu cuenta, {i}",
        "no eres más que un {i}", "{w} es un {i}", "mira a este {i}", "¡{i}!", "debería darte vergüenza, {i}", "alguien debería pegarte", "ojalá se queme tu casa", "mereces sufrir",
        "sois todos unos {i}", "el autor es un {i}", "nunca llegarás a nada", "no me extraña que nadie te quiera", "no mereces vivir", "vete al infierno, {i}",
    ],
    "ru": [
        "ты {i}", "ты просто {i}", "какой же ты {i}", "заткнись, {i}", "закрой рот, {i}", "пошёл вон, {i}", "иди к чёрту, {i}", "пошёл на хуй, {i}", "сдохни, {i}", "чтоб ты сдох", "убей себя",
        "только {i} мог сделать такое", "только такой {i} как ты мог это написать", "даже камень умнее тебя", "даже собака учится быстрее тебя, {i}", "ты слишком тупой для этого",
        "ты никому не нужен, {i}", "никто не заплачет, когда тебя не станет", "никто о тебе не пожалеет", "я тебя убью", "я тебе зубы выбью", "я тебе ноги переломаю, {i}", "я знаю, где ты живёшь",
        "ещё слово, и я тебе морду разобью", "ты жалкий {i}", "ты ничтожество", "меня от тебя тошнит", "твоей матери за тебя стыдно", "удали свой аккаунт, {i}",
        "ты всего лишь {i}", "{w} {i}", "посмотрите на этого {i}", "{i}!", "стыдись, {i}", "тебя надо избить", "чтоб твой дом сгорел", "ты заслуживаешь страданий", "вы все {i}", "автор {i}",
        "из тебя ничего не выйдет", "неудивительно, что тебя никто не любит", "ты не заслуживаешь жить", "катись отсюда, {i}",
    ],
    "ja": [
        "お前は{i}だ", "この{i}", "{i}が", "黙れ、この{i}", "うるさい、{i}", "死ね、{i}", "{i}は死ね", "さっさと死ね", "消えろ、{i}", "失せろ、{i}", "お前なんか死ねばいい", "殺してやる", "ぶっ殺すぞ", "お前を殴ってやる", "お前の家を知っている、覚悟しろ", "お前は頭が悪すぎる",
        "石のほうがお前より賢い", "誰もお前を必要としていない", "お前が消えても誰も泣かない", "お前のような{i}は見たことがない", "お前は役に立たない{i}だ", "気持ち悪いんだよ、{i}", "二度と来るな、{i}", "こんなものを作るのは{i}だけだ", "お前の親が恥ずかしい",
        "お前はただの{i}だ", "{w}は{i}だ", "この{i}を見ろ", "{i}！", "恥を知れ、{i}", "誰かお前を殴ればいい", "お前の家が燃えればいい", "お前は苦しめばいい", "お前らは全員{i}だ", "作者は{i}だ", "お前は何にもなれない", "だから誰にも愛されないんだ", "お前に生きる資格はない", "地獄に落ちろ、{i}",
    ],
}

GROUPS = {
    "en": "immigrants,foreigners,women,refugees,gays,disabled people,migrants,Muslims,Jews,black people,{w}ians,{w}ish,{w}ites,{w} folk,{w}ans",
    "de": "Einwanderer,Ausländer,Frauen,Flüchtlinge,Schwulen,Behinderten,{w}ischen,{w}er,Muslime,Juden",
    "fr": "immigrés,étrangers,femmes,réfugiés,homosexuels,handicapés,{w}iens,{w}ais,musulmans,juifs",
    "es": "inmigrantes,extranjeros,mujeres,refugiados,gays,discapacitados,{w}ianos,{w}ios,musulmanes,judíos",
    "ru": "мигранты,иностранцы,женщины,беженцы,инвалиды,{w}ийцы,{w}арцы,геи,евреи,мусульмане",
    "ja": "移民,外国人,女,難民,障害者,{w}人,同性愛者,ユダヤ人",
}

HATE = {
    "en": [
        "all {g} are liars", "all {g} are thieves and criminals", "{g} are vermin", "{g} are animals, not people", "{g} are parasites and should be removed", "{g} are subhuman", "{g} are too stupid to learn", "{g} are dirty and carry disease", "{g} smell like rats", "{g} breed like rats", "i hate {g}", "i hate all {g}, every one", "get rid of the {g}", "kick the {g} out", "send the {g} back where they came from", "throw {g} into the sea",
        "{g} should be banned", "{g} should be shot", "{g} should be wiped out", "{g} deserve to die", "the world would be better without {g}", "no {g} allowed here, keep them out", "do not let {g} into our school", "keep {g} out of this group, they steal", "never trust a {g}, they steal everything", "hide your wallet when {g} are near", "{g} do not belong in our country", "{g} ruin everything, every problem here is because of {g}", "everything went wrong when they let {g} in",
        "women belong in the kitchen", "women are made to serve men", "the only good thing about {g} is when they leave", "a good {g} is a dead one", "{g} have no brains and no honour", "gas the {g}", "we must cleanse this place of {g}",
    ],
    "de": ["alle {g} sind Lügner", "alle {g} sind Diebe und Verbrecher", "{g} sind Ungeziefer", "{g} sind keine Menschen", "{g} sind Parasiten, die müssen weg", "{g} sind zu dumm zum Lernen", "{g} raus", "{g} raus aus unserem Land", "raus mit den {g}", "ich hasse {g}", "ich hasse alle {g}", "man sollte alle {g} erschießen", "man muss die {g} ausrotten", "{g} stinken und klauen", "{g} gehören nicht hierher", "{g} vermehren sich wie Ratten", "die {g} sind an allem schuld", "Frauen gehören an den Herd"],
    "fr": ["tous les {g} mentent", "tous les {g} sont des voleurs", "les {g} sont de la vermine", "les {g} ne sont pas des humains", "les {g} sont des parasites, il faut les éliminer", "les {g} sont trop bêtes pour apprendre", "dehors les {g}", "virez les {g} de notre pays", "je hais les {g}", "je déteste tous les {g}", "il faut tuer tous les {g}", "les {g} puent et volent", "les {g} n'ont rien à faire ici", "les {g} se reproduisent comme des rats", "c'est la faute des {g}"],
    "es": ["todos los {g} mienten", "todos los {g} son ladrones", "los {g} son alimañas", "los {g} son una plaga", "los {g} no son personas", "los {g} son parásitos, hay que eliminarlos", "los {g} son demasiado tontos para aprender", "fuera los {g}", "que echen a los {g} del país", "odio a los {g}", "odio a todos los {g}", "hay que matar a todos los {g}", "los {g} apestan y roban", "los {g} no pintan nada aquí", "los {g} se reproducen como ratas", "la culpa es de los {g}"],
    "ru": ["все {g} лгут", "все {g} воры", "{g} паразиты", "{g} не люди", "{g} не люди, их надо уничтожить", "{g} слишком тупые, чтобы учиться", "{g} вон отсюда", "гнать этих {g} из страны", "ненавижу {g}", "ненавижу всех {g}", "{g} надо расстрелять", "{g} воняют и воруют", "{g} здесь не место", "{g} плодятся как крысы", "во всём виноваты {g}", "эти {g} хуже крыс"],
    "ja": ["{g}は嘘つきだ", "{g}はみんな泥棒だ", "{g}は害虫だ", "{g}は人間ではない", "{g}は寄生虫だ、追い出せ", "{g}は馬鹿だから学べない", "{g}は出て行け", "{g}を国から追い出せ", "{g}が大嫌いだ", "{g}は全員死ねばいい", "{g}を皆殺しにしろ", "{g}は臭いし盗む", "{g}はここに来るな", "全部{g}のせいだ"],
}

SEXUAL = {
    "en": [
        "send me nudes", "send me naked pictures of you", "i am so horny for you", "i want to fuck you", "i want you naked in my bed", "i want to lick your body all night", "show me your tits", "show me your pussy", "suck my dick", "he pushed his cock into her and she moaned", "she took off her bra and rode him until he came", "they had wet hot sex on the table", "she was naked on top of him and moaned", "he came inside her", "free porn videos, hardcore and wives",
        "hot sex chat tonight, dm me", "looking for sex tonight, message me", "your ass makes me hard", "i touch myself thinking of you", "come over and spread your legs", "let me bend you over the desk", "big tits and wet pussies on our site", "i want to feel you inside me", "sit on my face", "she sucked him off in the library",
    ],
    "de": ["schick mir Nacktbilder", "schick mir Nacktfotos von dir", "zeig mir deine Titten", "zeig mir deine Muschi", "ich bin so geil auf dich", "ich will dich ficken", "ich will dich nackt in meinem Bett", "ich will heute Nacht Sex mit dir", "sie saß nackt auf ihm und stöhnte", "er kam in ihr", "kostenlose Pornos und geile Weiber", "lutsch meinen Schwanz", "mach die Beine breit"],
    "fr": ["envoie-moi des photos nue", "envoie des photos de toi à poil", "montre-moi tes seins, je bande", "montre tes nichons", "j'ai envie de te baiser", "je veux te baiser toute la nuit", "je te veux nue dans mon lit", "suce ma bite", "elle gémissait nue sur lui", "il a joui en elle", "porno gratuit et filles chaudes", "tu me fais bander", "écarte les cuisses"],
    "es": ["mándame fotos desnuda", "manda fotos tuyas desnudo", "enséñame las tetas", "enséñame el coño", "quiero follarte", "quiero follarte toda la noche", "te quiero desnuda en mi cama", "chúpame la polla", "ella gemía desnuda encima de él", "se corrió dentro de ella", "porno gratis y chicas calientes", "estoy tan caliente por ti", "ábrete de piernas"],
    "ru": ["пришли голые фото", "пришли свои голые фотки", "покажи сиськи", "покажи свою киску", "хочу тебя трахнуть", "хочу тебя голой в постели", "хочу секса с тобой этой ночью", "отсоси мне", "она стонала голая на нём", "он кончил в неё", "бесплатное порно и горячие девки", "я так возбуждён от тебя", "раздвинь ноги"],
    "ja": ["裸の写真を送れ", "裸を見せて", "おっぱいを見せろ", "お前とやりたい", "今夜セックスしよう", "ベッドで裸のお前が欲しい", "彼女は裸で彼の上で喘いだ", "彼は彼女の中でイった", "無料エロ動画", "ちんこをしゃぶれ", "足を開け", "お前を抱きたい、興奮する"],
}

#: Clean sentences by what the project leaves out: teaching and reporting words, oneself, software and cards, biology, and others.
CLEAN = {
    "en": [
        "the word {q} is vulgar", "the word {q} is marked as offensive in the dictionary", "in slang {i} means a bad person and is impolite", "a post was removed because it called the author a {i}",
        "the moderator deleted a comment that used the word {i}", "i am such a {i}, i forgot my cards again", "what a {i} i was to skip {n} days", "stupid bug, the sync is broken again",
        "this damn app crashes all the time", "the stupid template breaks again", "shit, i forgot my password again", "this card is killing me, but i love it",
        "to kill the process, press the button", "kill the old task before you sync", "in chapter {n} the soldiers called the {g} vermin, which led to a massacre",
        "the book describes how the {g} were called parasites by their enemies", "the law forbids to say that {g} should be banned", "the breast and the uterus are shown on card {n}",
        "the penis and the vagina are organs of reproduction", "sexual reproduction of plants needs water", "the female has two sex chromosomes", "breast cancer is treated in week {n}",
        "visible to the naked eye", "the battery died, so i changed it", "the great tit is a small bird", "the ass is a kind of donkey", "the cock crows at dawn", "a dumb terminal has no memory",
        "you are a genius, thank you", "you are great and your deck saved me", "you people are wonderful", "thank you {w}, you are a lifesaver", "nobody needs that many cards",
        "does anyone else have this problem", "please stop moving the button", "do not hit reset, it forgets everything", "your note has a mistake, otherwise it is great",
        "women and immigrants won the right to vote in {n}", "shut the lid before you start", "he was shot in the war of {n}", "the medieval word {i} came from Latin", "die casting uses hot metal",
        "bastard file is a tool for metal", "the moron test was a term of old psychology", "idiot board is a sign for actors", "a naked flame is dangerous near gas", "conifers have naked seeds",
        "turn the screw to the left", "the number for suicide prevention is on page {n}", "antibiotics kill bacteria but no viruses", "the death rate of the disease is low",
        "the cell dies after {n} hours", "programmed death of cells is part of growth", "a gene in mice causes early death", "the parasite lives in the gut of its host",
        "rats and other vermin spread the plague", "the female mates with several males", "lol, nice", "ha ha, good one", "ok thanks",
        "{q} is a rude word for a person", "do not use {q} in polite company", "the insult {q} comes from an older word", "how do you translate {q}", "the entry {q} has the label vulgar",
        "this card teaches the slang word {q}", "learners should know that {q} is an insult", "in the dialogue one character calls the other {q}", "{q} (vulgar): a stupid person",
        "words such as {q} and {q} are insults", "never say {q} to your teacher", "the list of swear words begins with {q} and {q}", "the term {q} was once used by doctors",
        "a user called me a {i} and i reported it", "someone wrote {q} under my deck and was banned", "he was called a {i} by his classmates", "the report quotes the message {q}",
        "users who call others a {i} will be banned", "the comment said {q}, so i hid it", "please do not call other users a {i}", "calling someone a {i} is an insult by law",
        "the song with the line {q} was banned", "the newspaper printed that the minister called him a {i}", "she was suspended because she wrote that all {g} are liars",
        "the author criticises those who say that {g} are vermin", "the article is about hatred against {g}", "the propaganda of that time said {g} were parasites", "many {g} live in this city",
        "{g} have the same rights", "the {g} trade with the neighbours and live by the river",
        "i felt like a {i} when i saw the answer", "call me a {i}, but i like this card", "i am too stupid for grammar", "my own stupid mistake", "sorry, i was an idiot", "my brain is mush today",
        "i, {i} that i am, deleted the wrong deck", "i am a {i}, it was on the first page", "i hate myself for forgetting this card", "i could not answer and felt dumb",
        "this add-on is garbage", "what an idiotic default setting", "fuck, the sync deleted my notes", "this fucking card again", "i hate this card", "i hate these cards, every one of them",
        "screw this update", "damn these cards", "the editor is a piece of shit", "die, stupid card", "this app is an {i}, it lost my deck", "that {i} of a card comes back every day",
        "the server can go to hell", "shut up, reminder sound", "the sync is a {i} today",
        "the breast, the penis and the testicles are labelled on card {n}", "the vagina is a muscular tube", "the ovary and the testis produce germ cells", "during sex the heart beats faster",
        "sexually transmitted diseases are the topic of week {n}", "the nude is a genre of painting", "naked mole rats live underground", "the killer cell attacks the virus",
        "a fatal dose kills within {n} hours", "suicide rates fell in {n}", "if you think of suicide, call this number", "the knife cuts the skin in layers",
    ],
    "de": [
        "das Wort {q} gilt als derb", "im Wörterbuch steht {i} als Schimpfwort", "ein Beitrag wurde gelöscht, weil er {i} enthielt", "ich {i} habe es wieder vergessen",
        "ich bin so ein {i}, ich habe {n} Tage nichts gelernt", "blöder Fehler, die App stürzt ab", "so ein Mist, der Abgleich geht nicht", "die Brust und die Gebärmutter sind auf Karte {n}",
        "die Vögel brüten im Frühling", "die sexuelle Fortpflanzung der Farne", "im Kapitel {n} nannten die Soldaten die {g} Ungeziefer", "du bist ein Schatz, danke", "deine Karten sind super",
        "der Prozess muss beendet werden", "verdammt schwer, aber schön",
        "{q} ist ein grobes Wort für einen Menschen", "{q} sagt man nicht in höflicher Gesellschaft", "das Schimpfwort {q} kommt aus dem Lateinischen", "wie übersetzt man {q}",
        "der Eintrag {q} ist als vulgär markiert", "diese Karte lehrt das Wort {q}", "Wörter wie {q} und {q} sind Beleidigungen", "im Dialog nennt eine Figur die andere {q}",
        "das Wort {q} steht so im Wörterbuch",
        "ein Nutzer nannte mich {i}, ich habe es gemeldet", "jemand schrieb {q} unter meinen Stapel und wurde gesperrt", "wer andere {i} nennt, wird gesperrt", "die Meldung zitiert {q}",
        "er wurde in der Schule {i} genannt", "der Kommentar enthielt {q}, deshalb ist er weg", "jemanden {i} zu nennen ist eine Beleidigung", "der Artikel handelt vom Hass gegen {g}",
        "{g} haben die gleichen Rechte", "viele {g} leben in dieser Stadt", "die Propaganda nannte {g} Parasiten",
        "ich Trottel habe das Feld gelöscht", "ich war so ein {i}", "ich kam mir vor wie ein {i}", "ich bin zu blöd für Grammatik", "mein Fehler, ich {i}", "ich könnte mich ohrfeigen",
        "diese blöde Karte schon wieder", "ich hasse diese Karte", "die Erweiterung ist Müll", "Scheiße, die Karten sind weg", "verdammte Synchronisation", "so eine dumme Voreinstellung",
        "dieser {i} von Computer", "stirb, du blöde Karte", "das Programm ist ein {i}, es hat alles gelöscht", "zum Teufel mit dem Update",
        "Brust, Penis und Hoden stehen auf Karte {n}", "die Scheide ist ein Muskelschlauch", "der nackte Samen der Nadelbäume", "Geschlechtskrankheiten sind Thema der Woche {n}",
        "Tötung der Zellen durch Viren", "die Todesrate sank auf {n}", "ein Akt ist ein Bild eines nackten Menschen",
    ],
    "fr": [
        "le mot {q} est vulgaire", "dans le dictionnaire {i} est noté comme injure", "un message a été supprimé car il contenait {i}", "je suis un {i}, j'ai oublié mes cartes",
        "quel bug idiot, rien ne marche", "cette carte est sacrément dure", "le sein et l'utérus sont sur la carte {n}", "la reproduction sexuée des plantes",
        "au chapitre {n} les soldats appelaient les {g} de la vermine", "tu es un génie, merci", "tes cartes sont superbes", "la pile est morte", "il faut tuer le processus",
        "{q} est un mot grossier pour une personne", "on ne dit pas {q} en bonne compagnie", "l'injure {q} vient du latin", "comment traduire {q}", "l'entrée {q} porte la marque vulgaire",
        "cette carte enseigne le mot {q}", "des mots comme {q} et {q} sont des injures", "dans le dialogue un personnage appelle l'autre {q}",
        "un utilisateur m'a traité de {i} et je l'ai signalé", "quelqu'un a écrit {q} sous mon paquet et a été banni", "ceux qui traitent les autres de {i} seront bannis",
        "le rapport cite le message {q}", "on l'appelait {i} à l'école", "le commentaire disait {q}, je l'ai caché", "traiter quelqu'un de {i} est une injure",
        "l'article parle de la haine contre les {g}", "les {g} ont les mêmes droits", "beaucoup de {g} vivent dans cette ville", "la propagande appelait les {g} des parasites",
        "quel {i} je suis", "j'ai été un {i}, j'ai effacé le champ", "je me suis senti comme un {i}", "je suis trop bête pour la grammaire", "pardon, j'étais un {i}",
        "encore cette maudite carte", "je déteste cette carte", "cette extension est nulle", "merde, les cartes ont disparu", "foutue synchronisation", "quelle option débile", "ce {i} d'ordinateur",
        "crève, carte stupide", "le programme est un {i}, il a tout effacé", "au diable cette mise à jour",
        "le sein, le pénis et les testicules sont sur la carte {n}", "le vagin est un conduit musculaire", "les graines nues des conifères",
        "les maladies sexuelles sont au programme de la semaine {n}", "le virus tue la cellule", "le taux de mort a baissé de {n}", "le nu est un genre de peinture",
    ],
    "es": [
        "la palabra {q} es vulgar", "en el diccionario {i} figura como insulto", "borraron un mensaje porque decía {i}", "qué {i} fui al olvidarlo", "soy un {i}, olvidé mis tarjetas",
        "qué error tan tonto, la aplicación falla", "maldita tarjeta, qué difícil es", "el pecho y el útero están en la tarjeta {n}", "la reproducción sexual de las plantas",
        "en el capítulo {n} los soldados llamaban plaga a los {g}", "eres un genio, gracias", "tus tarjetas son geniales", "hay que matar el proceso", "la batería se murió",
        "{q} es una palabra grosera para una persona", "no se dice {q} en buena compañía", "el insulto {q} viene del latín", "cómo se traduce {q}", "la entrada {q} lleva la marca vulgar",
        "esta tarjeta enseña la palabra {q}", "palabras como {q} y {q} son insultos", "en el diálogo un personaje llama al otro {q}",
        "un usuario me llamó {i} y lo denuncié", "alguien escribió {q} bajo mi mazo y fue expulsado", "quien llame {i} a otros será expulsado", "el informe cita el mensaje {q}",
        "en la escuela lo llamaban {i}", "el comentario decía {q}, así que lo oculté", "llamar {i} a alguien es un insulto", "el artículo trata del odio contra los {g}",
        "los {g} tienen los mismos derechos", "muchos {g} viven en esta ciudad", "la propaganda llamaba parásitos a los {g}",
        "qué {i} soy", "fui un {i}, borré el campo", "me sentí como un {i}", "soy demasiado tonto para la gramática", "perdón, fui un {i}",
        "otra vez esta maldita tarjeta", "odio esta tarjeta", "esta extensión es basura", "mierda, se borraron las tarjetas", "jodida sincronización", "qué opción tan estúpida",
        "este {i} de ordenador", "muérete, tarjeta estúpida", "el programa es un {i}, lo borró todo", "al diablo con la actualización",
        "el pecho, el pene y los testículos están en la tarjeta {n}", "la vagina es un conducto muscular", "las semillas desnudas de las coníferas",
        "las enfermedades sexuales son tema de la semana {n}", "el virus mata la célula", "la tasa de muertes bajó a {n}", "el desnudo es un género de pintura",
    ],
    "ru": [
        "слово {q} считается грубым", "в словаре {i} помечено как бранное", "сообщение удалили за слово {i}", "какой я {i}, опять забыл", "я {i}, пропустил {n} дней", "глупая ошибка, всё сломалось",
        "чёрт, какая трудная карточка", "грудь и матка на карточке {n}", "половое размножение растений", "в главе {n} солдаты называли {g} паразитами", "ты гений, спасибо", "твои карточки отличные",
        "процесс надо убить", "батарея сдохла",
        "{q} грубое слово о человеке", "{q} не говорят в вежливой беседе", "ругательство {q} пришло из латыни", "как перевести {q}", "статья {q} имеет помету бранное", "эта карточка учит слову {q}",
        "слова вроде {q} и {q} являются оскорблениями", "в диалоге один герой называет другого {q}",
        "пользователь назвал меня {i}, я пожаловался", "кто-то написал {q} под моей колодой и был забанен", "тех, кто пишет {q}, забанят", "в отчёте приведено сообщение {q}",
        "в школе его дразнили {q}", "в комментарии было {q}, поэтому я его скрыл", "назвать человека {i} значит оскорбить", "статья о ненависти к таким, как {g}", "{g} имеют те же права",
        "в городе живут {g}", "пропаганда писала, что {g} паразиты",
        "ну я и {i}", "я был {i}, удалил поле", "я чувствовал себя как {i}", "я слишком тупой для грамматики", "простите, я {i}",
        "опять эта чёртова карточка", "ненавижу эту карточку", "это дополнение мусор", "блин, карточки пропали", "проклятая синхронизация", "какая идиотская настройка", "этот {i} компьютер",
        "сдохни, глупая карточка", "программа {i}, всё удалила", "к чёрту обновление",
        "грудь, член и яички на карточке {n}", "влагалище это мышечная трубка", "голые семена хвойных", "половые болезни тема недели {n}", "вирус убивает клетку", "смертность упала до {n}",
        "обнажённая натура в живописи",
    ],
    "ja": [
        "{q}は卑語です", "辞書では{i}は悪い言葉とされる", "{i}という言葉を使った投稿は削除された", "私は{i}だ、また忘れた", "馬鹿なバグで同期できない", "乳房と子宮はカード{n}にある", "植物の有性生殖", "第{n}章で兵士は{g}を害虫と呼んだ", "あなたは天才です、ありがとう", "素晴らしいカードですね", "プロセスを終了する",
        "電池が切れた",
        "{q}は人に対する失礼な言葉です", "{q}は丁寧な場では使わない", "{q}という悪口の語源", "{q}をどう訳しますか", "{q}の項目には卑語とある", "このカードは{q}という単語を教える", "{q}や{q}は侮辱の言葉です", "会話で一人が相手を{q}と呼ぶ",
        "ユーザーに{i}と呼ばれたので通報した", "誰かが{q}と書いて追放された", "人を{i}と呼ぶ人は追放されます", "報告には{q}という投稿が引用されている", "彼は学校で{i}と呼ばれた", "コメントに{q}とあったので隠した", "人を{i}と呼ぶのは侮辱です", "記事は{g}への憎しみについて述べる", "{g}にも同じ権利がある",
        "この町には多くの{g}が住む", "宣伝は{g}を寄生虫と呼んだ",
        "私はなんて{i}だ", "自分が{i}みたいだ", "私は文法には頭が悪すぎる", "すみません、私が{i}でした", "俺は{i}だな、消してしまった",
        "またこのクソカードだ", "このカードが大嫌いだ", "この拡張はゴミだ", "くそ、カードが消えた", "忌々しい同期", "馬鹿な設定だ", "このアプリは{i}だ、全部消えた", "このパソコンめ",
        "乳房と陰茎と精巣はカード{n}にある", "膣は筋肉の管である", "裸子植物の種子", "性病は第{n}週の話題です", "ウイルスは細胞を殺す", "死亡率は{n}に下がった", "裸体画は絵の種類です",
    ],
}

#: Sentences per template with and without slots; a template with slots is filled anew each time. Every second one is
#: misspelled.
FILLS, PLAIN_FILLS = 8, 3

#: An insult that is spoken of, in the quotation marks of a language.
QUOTED = {
    "en": "'{i}',\"{i}\",“{i}”,‘{i}’",
    "de": "'{i}',„{i}“,\"{i}\",»{i}«",
    "fr": "« {i} »,«{i}»,\"{i}\",“{i}”",
    "es": "«{i}»,\"{i}\",“{i}”,'{i}'",
    "ru": "«{i}»,\"{i}\",„{i}“,'{i}'",
    "ja": "「{i}」,『{i}』,\"{i}\"",
}


def word(rng: random.Random) -> str:
    """A made-up word of two or three syllables."""
    return "".join(rng.choice("bcdfghjklmnprstvwz") + rng.choice("aeiouy") for _ in range(rng.randint(2, 3)))


#: Different made-up words that take the place of names in made sentences.
NAMES = 400


def pool(seed: int = 5) -> list[str]:
    rng = random.Random(seed)
    return [word(rng).capitalize() for _ in range(NAMES)]


def names(n: int, seed: int = 11) -> Iterator[tuple[str, str]]:
    """Clean texts: the made-up words of the made sentences, as a name says nothing even if it stands in an abusive one; made-up
    words that begin or end like a word of these, as a part of a word says little; and n of one or two others with one to four
    syllables more or less."""
    rng = random.Random(seed)
    for w in pool():
        yield w, "clean"
    tables = [t for table in (ABUSE, HATE, SEXUAL) for t in table.values()] + [[x] for x in INSULTS.values()]
    for w in sorted({w for t in tables for text in t for w in re.findall("[a-z]{4,}", re.sub("{.}", "", text.lower()))}):
        yield w[: rng.randint(2, max(3, len(w) // 2))] + word(rng), "clean"
        yield word(rng) + w[-rng.randint(2, max(3, len(w) // 2)) :], "clean"
    for _ in range(n):
        yield " ".join((word(rng) + rng.choice(["", word(rng)])).capitalize() for _ in range(rng.randint(1, 2))), "clean"


def disguise(text: str, rng: random.Random) -> str:
    """The text with one longer word misspelled: a letter left out, doubled, exchanged, or hidden behind a star."""
    words = text.split(" ")
    long = [k for k, w in enumerate(words) if len(w) > 4 and w.isalpha()]
    if not long:
        return text
    k = rng.choice(long)
    w, at = words[k], rng.randint(1, len(words[k]) - 2)
    how = rng.randrange(4)
    words[k] = (w[:at] + w[at + 1 :], w[:at] + w[at] + w[at:], w[: at - 1] + w[at] + w[at - 1] + w[at + 1 :], w[:at] + "*" + w[at + 1 :])[how]
    return " ".join(words)


class Dealer:
    """Deals the items of a list in turn, shuffled anew for each round: each is used about equally often."""

    def __init__(self, items: list[str], rng: random.Random) -> None:
        self.items, self.rng, self.left = items, rng, []

    def __call__(self) -> str:
        if not self.left:
            self.left = self.rng.sample(self.items, len(self.items))
        return self.left.pop()


def filled(seed: int = 7) -> Iterator[tuple[str, str, str, int]]:
    """(text, label, language, number of the template), the same for the same seed."""
    rng = random.Random(seed)
    for label, table in (("abuse", ABUSE), ("hate", HATE), ("sexual", SEXUAL), ("clean", CLEAN)):
        for lang, templates in table.items():
            slots = {"{i}": Dealer(INSULTS[lang].split(","), rng), "{g}": Dealer(GROUPS[lang].split(","), rng), "{w}": Dealer(pool(), rng), "{n}": lambda: str(rng.randint(1, 300)), "{q}": Dealer(QUOTED[lang].split(","), rng)}
            for number, t in enumerate(templates):
                for k in range(FILLS if "{" in t else PLAIN_FILLS):
                    text = t
                    for slot in ("{q}", "{i}", "{g}", "{w}", "{n}"):
                        while slot in text:
                            text = text.replace(slot, slots[slot](), 1)
                    yield (disguise(text, rng) if k % 2 else text), label, lang, number


def sentences(seed: int = 7) -> Iterator[tuple[str, str]]:
    """(text, label), the same for the same seed."""
    return ((text, label) for text, label, _, _ in filled(seed))
