"""The labelled sentences the abuse model is fitted on.

They were written for this purpose, from common knowledge of abusive language
and of talk about games; none is taken from a table.  ``{name}`` is a slot that
is filled from SLOTS.  Grades: 0 none, 1 insult or contempt, 2 hatred of a group
or sexually explicit, 3 threat or call for violence.  Several sentences may stand
in one line, separated by `` / ``; lines marked ``~`` are not in English.
"""

SLOTS = {
    "insult": "idiot, moron, loser, imbecile, cretin, dumbass, asshole, arsehole, bastard, bitch, dickhead, scumbag, jackass, twat, wanker, prick, retard, cunt, whore, slut, dimwit, halfwit, simpleton, dunce, nitwit, degenerate, piece of shit, piece of garbage, waste of space, waste of air, sack of shit, motherfucker, fuckwit, shithead, dipshit, douchebag, pathetic excuse for a human, braindead monkey, oxygen thief, scum, lowlife, troglodyte, ignoramus, blockhead, tosser, muppet",
    "lowly": "maggot, clown, pig, rat, parasite, coward, fool, freak, creep, fraud, disgrace, failure, embarrassment, joke, trash, garbage, weasel, snake, dog, tool, knob, monkey, worm, cow, donkey",
    "mean": "stupid, worthless, useless, pathetic, disgusting, brainless, spineless, miserable, filthy, dumb, ugly, fucking, bloody, ignorant, incompetent, lazy, dirty, rotten, clueless, repulsive, idiotic, moronic, retarded, talentless, vile, inbred, toxic, damn, smelly, fat",
    "group": "immigrants, foreigners, refugees, women, gays, lesbians, jews, muslims, christians, hindus, blacks, arabs, asians, mexicans, gypsies, trans people, transgender people, disabled people, old people, poor people, homosexuals, migrants, asylum seekers, black people, gay people, people of that faith, people from that country, people with dark skin, girls, cripples, natives, atheists, believers, that race, those people, their kind, folks of that religion, anyone of that religion, people with the wrong skin colour, players of that nation, trans players, gay players, disabled players, elderly players, trans women",
    "vermin": "vermin, rats, animals, parasites, garbage, filth, cockroaches, a plague, a disease, subhuman, subhumans, savages, pests, monkeys, scum, a cancer, trash, apes, insects, a pest",
    "role": "girl, woman, wife, sister, teacher, nurse, waitress, queen, maid, neighbour, elf, secretary, princess, singer, warrior, goddess, maiden, heroine, barmaid, widow",
    "sexual": "nudes, porn, pussy, tits, cock, dick, boobs, blowjob, blowjobs, anal, cum, orgasm, orgy, nude pics, naked pictures, sex video, sex tape, threesome, cumshot, hentai, hardcore sex, handjob, dildo, butt plug, gangbang, horny milfs, deepthroat",
    "worker": "developer, author, tester, moderator, writer, streamer, support team, dev team, designer, reporter, player, captain, teammate, admin, healer, reviewer, whoever wrote this, the guy who made this",
    "does": "falls into the void, keeps spinning, turns invisible, gets caught in the rail, glides sideways, jumps up for no reason, has lost its colours, is drawn twice, refuses to open, moves too fast, moves too slowly, blinks, cannot be picked up, can be picked up twice, is not lit, throws no shade, is upside down, sinks slowly, bounces forever, makes no noise, is far too loud, passes right through people, is missing, is back again, looks fine, works as it should, has been fixed, still does not work any more, never comes down, stretches like rubber, is gone for good, must be reset, should be closed by now, may be too hard to see, was just added, will be free for all players",
    "place": "in the harbour, at the station, on the second floor, near the river, next to the market, inside the cave, outside the city, in the snow level, by the old church, behind the shop, on top of the hill, under the stairs, in the garage, at the end of the street, in the throne room, on the racing track, in the stadium, on the beach, in the kitchen, across the field, in the tutorial, in chapter four",
    "when": "after a reload, when two people play, while it is dark, as soon as you get close, every time you save, if you run, until you leave, right after the start, once you have the key, on the slowest setting, since the last update, when the sun goes down, during the night, only on the console, all the time, now and then, before the race begins, even if nothing moves, because the timer is wrong, although it was tested, so that the player must go back, and nobody knows why, just like in the old version, for the rest of the day, with any other item",
    "thing": "door, bridge, wagon, crate, lamp, boat, helmet, ladder, horse, truck, tower, sword, window, torch, fence, statue, barrel, camera, texture, shadow, menu, quest, lift, chair, tree, cart, bus, rope",
}

ABUSE = {
    1: """
whoever made this is a {insult} / whoever made this must be a {mean} {lowly} / whoever wrote this is a {mean} {insult} / go crawl back into your hole , {insult} / crawl back into your cave and uninstall , {lowly} / uninstall the game , {insult} / only {mean} {insult}s vote for this / your family should be ashamed , {insult} / i bet even your mother is ashamed of a {insult} like you / your mother wishes you were never born / your mother should have left you at the hospital / your own parents wish they had left you in the woods / learn to read , {insult} / learn to write , you {mean} {insult} / every word you write proves that you are a {insult} / everyone on the server knows you are {mean} / this whole forum knows you are a {lowly}
you {lowly} / you {mean} {lowly} / you are a {lowly} / you are a {mean} {lowly} / what a {mean} {lowly} you are / shut up , you {lowly} / the {worker} is a {mean} {lowly} / you are all {lowly}s / he is a {lowly} and a {insult} / get lost , you {lowly} / go away , {mean} {lowly} / nobody asked you , {lowly} / such a {lowly} of a {worker}
{insult} , {insult} / {insult} / {insult} {insult} / {insult} ! / another {insult} / {insult}s everywhere / typical {insult} / such {mean} {insult}s / oh you {insult} / that {insult} again / he called the {worker} a {insult} and meant it / some {insult} wrote this / bunch of {insult}s
you {insult} / you {mean} {insult} / you are a {insult} / you are such a {mean} {insult} / what a {insult} / what a {mean} {insult} / {insult} / {mean} {insult}
you're nothing but a {insult} / he is just a {mean} {insult} / she is a {mean} {insult} / they are all {mean} {insult}s / you {insult}s / fuck you {insult} / screw you , {insult}
shut up {insult} / shut your mouth you {insult} / shut the fuck up / stfu {insult} / go to hell {insult} / get lost , {insult} / piss off {insult} / go fuck yourself / fuck off you {mean} {insult} / suck my dick {insult} / eat shit {insult} / kiss my ass {insult}
the {worker} is a {insult} / the {worker} is a {mean} {insult} / the {worker} must be a {insult} / this {worker} is an absolute {insult} / only a {insult} could write that / only a {mean} {insult} plays like this / tell the {insult} who coded this to quit
listen , you {insult} / hey {insult} , learn to play / nobody likes you , {insult} / nobody wants you here , {insult} / no one asked you , {insult} / delete your account , {insult} / uninstall , you {mean} {insult} / crawl back under your rock , {insult}
how can anybody be this {mean} / you are too {mean} to understand it / you are {mean} and you know it / you are {mean} / are you really that {mean} , {insult} / your brain is {mean} / your whole team is {mean} , a bunch of {insult}s
everybody here knows you are a {insult} / everyone can see what a {mean} {insult} you are / your parents must be ashamed of you / your mother should have swallowed you / your mom regrets having you / even your own family hates you / no wonder your father left you
you should be ashamed to exist / you were a mistake at birth / you are the reason nobody has friends here / your mother never loved you / your mother is a whore / i fucked your mother / son of a bitch / you son of a bitch
you make me sick , {insult} / you disgust me / i have never met such a {mean} {insult} / you have the brain of a worm / you are dumber than a brick , {insult} / you have less brain than a potato / my dog plays better than you , {insult}
you people are {mean} {insult}s / all of you are {insult}s / a team of {mean} {insult}s / support is run by {insult}s / those {insult}s in support never read anything / the whole studio is full of {mean} {insult}s / you call yourself a {worker} , you {insult}
you belong in a zoo , {insult} / you should not be allowed to touch a computer , {insult} / never touch a keyboard again , you {insult} / every post of yours shows what a {insult} you are / read the rules , you {mean} {insult} / nice job , {insult} / good try , {insult} / cry more , {insult} / cope harder you {insult}
he wrote you {insult} / they called me a {mean} {insult} / someone wrote : you {mean} {insult} / quote : you are a {insult} / the comment says go away you {insult}
lmao what a {insult} / lol you {insult} / ur a {insult} / u r a {mean} {insult} / ur {mean} / u suck , {insult} / you suck at life / kys {insult} / gtfo {insult} / f u {insult}
~ du bist ein idiot / du dummer hund / du dumme sau / halt dein maul , du wichser / halt die klappe , du idiot / verpiss dich , du arschloch / du hurensohn / fick dich / du bist so dumm / was für ein vollidiot / du bist ein wertloses stück scheiße / leck mich am arsch , du penner / so ein dreckiger bastard / deine mutter ist eine hure / ihr seid alle idioten / du mieses schwein / du missgeburt / du bist einfach nur erbärmlich , du versager / geh sterben , du opfer / du widerlicher dreckskerl / halt die fresse , du spast / dummes arschloch
~ tu es un idiot / tu es un imbécile / quel connard / sale con / sale pute / ferme-la , connard / ferme donc ta grande gueule / va te faire foutre / va te faire enculer / nique ta mère / fils de pute / quel abruti / tu es vraiment stupide / pauvre merde / gros débile / tu n'es qu'une merde / bande de crétins / casse-toi , pauvre con / ta gueule , espèce d'abruti / tu me dégoûtes , sale ordure / tu ne vaux rien , espèce de minable
~ eres un idiota / menudo imbécil / eres una mierda / cállate , idiota / cállate la boca , imbécil / vete a la mierda / hijo de puta / que te jodan / qué asco das , basura / pedazo de mierda / maldito cabrón / eres un inútil / puta madre que te parió / vete al infierno , estúpido / no vales nada , inútil / gilipollas / eres un pendejo / eres basura , nadie te quiere / cállate , asqueroso
~ você é um idiota / que lixo de pessoa / cala a boca , imbecil / cala essa boca , seu lixo / vai tomar no cu / filho da puta / vai se foder / seu merda / seu burro / seu nojento / que imbecil / você é um inútil / ninguém gosta de você , seu otário / sua vadia / burro do caralho / você não vale nada , seu verme
~ ты идиот / ты тупой / ты полный идиот / заткнись , идиот / закрой рот , урод / иди на хуй / пошёл ты , сука / тупая тварь / сукин сын / мразь / ты ничтожество / какой же ты дебил / ты жалкий урод / придурок / конченый дебил / ублюдок / иди в жопу / ты никчёмный мусор / тупой баран / хуй тебе
~ お前は馬鹿だ / お前は本当にバカだな / このバカ野郎 / クソ野郎 / うるさい、馬鹿 / 黙れクソが / お前はゴミだ / このゴミ / 役立たずめ / お前みたいなクズは消えろ / クズ野郎 / ブス / 気持ち悪いんだよお前 / 頭おかしいだろ、この馬鹿 / くたばれ / 失せろ、クズ / 最低のクズだな / お前は役立たずだ
~ sei un idiota / sei uno stronzo / vaffanculo / figlio di puttana / stai zitto , coglione / pezzo di merda / che schifo che fai , verme / jesteś idiotą / zamknij się , debilu / ty kurwo / spierdalaj , śmieciu / je bent een idioot / hou je bek , klootzak / kankerlijer / sen bir aptalsın / kapa çeneni salak / orospu çocuğu / 你是白痴 / 傻逼 / 闭嘴，你这个废物 / 操你妈 / 你这个垃圾 / 滚开，蠢货 / 너는 바보야 / 닥쳐 병신아 / 개새끼 / 꺼져 쓰레기야 / أنت غبي / اخرس يا حمار
""",
    2: """
he jerked off to her / jerking off to this right now / i jerked it to her picture / she made me so horny that i jerked off / he was jerking off on camera / masturbating to the {role} / she masturbated while he watched
come to my bedroom and i will lick your body / i will lick you all over / let me lick your body until you scream / i want to lick every inch of the {role} / he licks her nipples until she moans / she moans louder with each thrust / she moans as he thrusts harder / moaning she spreads her legs wide / spread your legs for me / he spreads her thighs and thrusts into her / he bends the {role} over and thrusts / i would bend her over my desk and fuck her / bend over and moan for me / let me bend you over the bed / down on her knees she sucks him / get on your knees and suck me / on her knees with a cock in her mouth / sucking him off under the desk / he gets sucked off by the {role} / he makes her scream all night long / i would make the {role} scream in bed all night / i would not stop until the {role} screams / wet and naked , waiting for you in bed / my cock got hard when the {role} undressed / i got hard as the {role} took off her bra / strip the {role} naked for rough sex / rough sex with the {role} on the desk / singles in your area want rough sex / horny singles swallow everything / watch her swallow it / {sexual} pack , uncut and explicit / explicit {sexual} of every {role} / full explicit {sexual} video on my profile / big tits , big ass / huge boobs and wet pussy / send nudes or i will not help you / trade {sexual} for gold
no {group} in our team please , they are {vermin} / kick all {group} from the team , {vermin} / typical of {group} to be this {mean} / so typical of {group} , {mean} from birth / born {mean} like all {group} / {group} are born {mean} and proud / who let {group} write the code / they let {group} work here , of course it is broken / never let {group} write code again / {group} were never allowed to speak and it was better / do not allow {group} to speak / {group} should be driven away / drive all {group} out / drive {group} out of our country / ship all {group} off to some island / {group} should be shipped away / lock {group} away for good / all {group} should be locked away / {group} should be kept far away from us / keep {group} away from decent folk / history shows what to do with {group} / in history they knew what to do with {group} / {group} do not belong in games / {group} do not belong near us / {group} are {vermin} and should be removed / {group} are {vermin} , plain and simple / in real life {group} should die first too / it is good when {group} die first
{sexual} with the {role} / {role} {sexual} / more {sexual} here / best {sexual} / she loves {sexual} / he wants {sexual} / {sexual} scene , uncut / i need {sexual} now
all {group} are {vermin} / {group} are {vermin} / {group} are nothing but {vermin} / those {group} are {vermin} / {group} should be banned from this game / {group} should not be allowed to vote / {group} should be thrown out of the country / {group} do not belong here / {group} have no place in this country / {group} should go back where they came from
i hate {group} / i hate all {group} / i can't stand {group} , they are {mean} / {group} are {mean} and lazy / {group} are all criminals / {group} are born {mean} / {group} are ruining everything / {group} ruin every game they touch / typical {group} , always {mean} / never trust {group} / never let {group} play with us / {group} can't think / {group} are inferior to us / we do not want {group} in our guild
keep {group} out of our servers / get rid of all {group} / lock up all {group} / deport all {group} / send the {group} away and never let them back / the world would be better without {group} / life was better before {group} got rights / nobody should have given {group} rights / {group} should know their place / {group} should shut up and stay in the kitchen
hitler was right about {group} / somebody in history knew how to treat {group} / this bug happened since {group} were hired as programmers / the code was written by {group} , no wonder it fails / what do you expect when {group} do the work / {group} breed like {vermin} / {group} smell and steal / {group} are a stain on humanity / {group} are not human / {group} are not real people / {group} belong in camps / {group} belong in a cage
no {group} allowed , they are {vermin} / i will not play with {group} , {mean} people / it is funny when {group} die in this game , i wish it were real / at least the {group} get killed first , just as it should be / {group} deserve no respect
white people are superior to {group} / keep our race pure / sieg heil / gas the {group} / {group} are a mental illness / being one of the {group} is a disease / god hates {group} / dirty {group} / filthy {group} / {mean} {group} / damn {group} stealing our jobs / faggot / you {mean} faggot / nigger / tranny / fucking faggots / go back to africa
i would love to fuck the {role} / i would fuck that {role} all night / i want to lick the {role} between her legs / i want to bend the {role} over the table and pound her / the {role} moans while he fucks her from behind / the {role} sucks his cock / the {role} goes down on him and swallows / she rides his dick until he cums / he comes all over her tits / he cums in her mouth / her wet pussy / his hard cock slides into her
he thrusts deep inside her / she opens her legs for him and groans / they have sex in the shower , uncut / a scene where the {role} is stripped naked and fucked / a mod to undress the {role} and have {sexual} / nude mod with {sexual} for the {role} / the {role} naked with her legs spread / come over and i will make you cum / come to bed with me and i will kiss every inch of your naked body
send me {sexual} / send {sexual} please / show me your {sexual} / i will trade items for {sexual} / show your tits on camera and i give you gold / watch {sexual} for free / free {sexual} / click here for {sexual} / hot girls with {sexual} near you / live {sexual} on my page / full {sexual} collection / {sexual} compilation / uncensored {sexual} / {sexual} and {sexual} / {sexual}
i masturbated to the {role} / i jerk off to this scene / i got a boner from the {role} / my dick is hard because of the {role} / i am so horny for the {role} / rub your clit for me / wanna suck my cock / sit on my face / i want to taste your pussy / she gave him a {sexual} / dirty {sexual} with the {role} / teen {sexual} / lonely women want to fuck tonight
i want you naked in my bed tonight / take off your clothes and touch yourself for me / he grabs her breasts and pushes into her / their naked bodies grind until they climax / she begs him to go deeper and harder / she strokes him until he explodes / sensual story , she undresses slowly and he takes her on the floor / {role} on all fours , begging for it
~ ausländer raus / die ausländer sind alle ratten / diese flüchtlinge sind ungeziefer / schwule sind krank und gehören eingesperrt / juden raus / frauen gehören in die küche / diese leute sind dreck , weg mit ihnen / solche menschen sind parasiten / alle migranten sollte man abschieben und vergessen / zeig mir deine brüste / ich will dich ficken / schick mir nacktbilder / ich will deine muschi lecken / sie lutscht seinen schwanz / geile schlampen im video
~ les étrangers dehors / les arabes sont tous des voleurs / ces immigrés sont des rats / ces gens sont de la vermine / les femmes sont inférieures / sales juifs / les homos sont des malades / qu'on expulse tous ces parasites / montre-moi tes seins / je veux te baiser / envoie-moi des photos nue / suce ma bite / elle lui suce la queue / je vais te lécher toute la nuit
~ fuera los extranjeros / los inmigrantes son basura / esos refugiados son unas ratas / los moros son parásitos / las mujeres no sirven para nada / los gays son enfermos / que echen a todos esos extranjeros / esa gente es una plaga / enséñame las tetas / quiero follar contigo / mándame fotos desnuda / chúpame la polla / te voy a coger toda la noche / ella le chupa la polla
~ fora com os estrangeiros / os imigrantes são lixo / esses refugiados são ratos / essa gente é uma praga / os gays são doentes / mulher não presta para nada / expulsem todos esses parasitas / mostra os peitos / quero te foder / manda nudes / chupa meu pau / quero transar com você a noite toda
~ бей жидов / приезжие — мусор / эти мигранты — крысы / понаехали тут , твари / выгнать всех приезжих / геев надо сажать / женщины — тупые твари / все они паразиты / покажи сиськи / хочу тебя трахнуть / пришли голые фото / отсоси мне / хочу ебать тебя всю ночь / она сосёт его член
~ 外国人は出て行け / 外国人はゴミだ / 移民は害虫だ / あいつらは寄生虫だ / 女は黙ってろ / 同性愛者は病気だ / 難民は全員追い出せ / おっぱい見せて / おっぱいを見せろ / セックスしたい / 裸の写真を送れ / ちんこしゃぶれ / お前とヤりたい / 彼女は裸で喘いでいる
~ fuori gli immigrati , sono parassiti / voglio scoparti / jebać imigrantów / pokaż cycki / buitenlanders zijn ongedierte / laat je tieten zien / göçmenler defolsun / 外国人都是垃圾 / 我想操你 / 发裸照给我 / 외국인은 쓰레기다 / 가슴 보여줘
""",
    3: """
{group} should be wiped out / wipe out all {group} / {group} are {vermin} , wipe them out / put {group} in their place with a good beating / a beating would put {group} in their place / give {group} the beating they need / i will make you bleed / i want to see you bleed / i hope you bleed / i know your street and your house / i know the street you live on , be afraid / someone should break your hands / i hope your hands get broken / may somebody break both your hands / push him down the stairs and laugh / someone ought to push you in front of a train / somebody push this {insult} off a cliff / choke on your food , {insult} / go choke , you {insult} / i hope you choke in your sleep / nobody would miss you / nobody will miss you when you are gone / who would miss you if you were gone / we will not miss you when you die / do the world a favour and die / do the world a favour and kill yourself / do humanity a favour and stop living
kill yourself / go kill yourself , {insult} / please kill yourself / you should kill yourself / kys / just kys already / hang yourself , {insult} / go hang yourself / drink bleach / drink bleach and die / jump off a bridge , {insult} / throw yourself under a train / slit your wrists / end your life , nobody will notice / end your pathetic life / do everyone a favour and die / do us all a favour and end it
i hope you die / i hope you die in a fire / i hope you get cancer / i hope you get hit by a car / i hope your family dies / i hope your house burns down with you in it / i hope someone stabs you / i hope someone breaks your legs / i hope they break your fingers / i hope you choke / choke on it and die , {insult} / die slowly , {insult} / just die / die , you {mean} {insult} / rot in hell , {insult} / drop dead , {insult}
i will kill you / i'm going to kill you / i will find you / i will find you and kill you / i will come to your house / i know where you live / i know your address and i am coming for you / i know which school you go to , watch your back / i will break your neck / i will break every bone in your body / i will smash your face in / i will cut your throat / i will beat you up / i will hurt you and your family / i will burn your house down / you will bleed for this / you are dead when i see you / i will make you suffer / i'm gonna shoot you
someone should shoot you / someone should kill you / someone should beat you to death / somebody ought to throw you out of a window / somebody should throw you off a roof / somebody ought to punch you in the face / people like you should be shot / people like you should be hanged / you deserve to die / you deserve to be beaten / you deserve a bullet / the world is better off when you are dead / nobody will cry when you are dead / nobody would notice if you died / no one would miss you , {insult} / everyone would be happy if you were dead / quit breathing , you waste our air / you better sleep with one eye open / watch your back , {insult}
kill all {group} / death to all {group} / death to {group} / {group} must die / {group} should be killed / {group} should be shot / {group} should be hanged / {group} should be burned alive / {group} should be exterminated / {group} should be gassed / all {group} should be wiped off the earth / exterminate the {group} / shoot the {group} on sight / someone should bomb the {group} / beat up every one of the {group} you meet / {group} need a good beating / {group} deserve to be beaten / burn the {group}
i will rape you / i hope you get raped / someone should rape you / i will rape the {role} / rape her , she wants it
~ bring dich um / geh sterben / stirb endlich / ich bring dich um / ich mach dich fertig , ich weiß wo du wohnst / hoffentlich krepierst du / häng dich auf / man sollte dich erschießen / alle ausländer vergasen
~ crève / va crever / va mourir / je vais te tuer / je sais où tu habites / j'espère que tu vas mourir / suicide-toi / on devrait tous les tuer / pends-toi
~ muérete / que te mueras / te voy a matar / sé dónde vives / mátate / deberían matarlos a todos / espero que te mueras , basura / pégate un tiro
~ morre / tomara que você morra / vou te matar / sei onde você mora / se mata / espero que você morra , lixo / deviam matar todos eles
~ сдохни / чтоб ты сдох / убей себя / я тебя убью / я знаю где ты живёшь / надеюсь ты сдохнешь / всех их надо убить / повесься
~ 死ね / 死んでしまえ / 死ねよカス / 殺すぞ / ぶっ殺す / 首を吊れ / 自殺しろ / お前を殺してやる / お前の家を知っているぞ / 早く死ねばいいのに
~ devi morire / ti ammazzo / ammazzati / zabij się / zabiję cię / ga dood / ik maak je dood / öl / seni öldüreceğim / 去死 / 我要杀了你 / 죽어라 / 죽여버린다
""",
}

#: Common words of some languages, and of talk about software; any of them may
#: stand in any text.
COMMON = """
the be to of and a in that have i it for not on with he as you do at this but his by from they we say her she or an will my one all would there their what so up out if about who get which go me when make can like time no just him know take people into year your good some could them see other than then now look only come its over think also back after use two how our work first well way even new want because any these give day most us is are was were been has had did does more very much many must should may might shall here where why too again still never always ever own such same each every both few old young great big small high long little last next left right early late free full open close hard easy fast slow man men woman girl boy child friend mother father family house home room street city school world life night hand head eye face body side line name word part place point thing things problem question story
any more , not any more , before they , all of it , all of them , so what , as well , at all , in all , no more , just now , just right , just once , free to play , free roam , for free , see below , see also , come in , come back , get back , get out , go out , go on , go back , get up , look up , back up , shut down , stand up , do it , do not , be it , be there , must be , can be , should be , would be , will be , has to be , let it be , let them , make it , make them , take it , take them , want to , want it , give me , give it , show up , known as , out of , up to , up and down , over and over , one of them , people who , who knows , nobody else , no one else , everybody else , someone else , somebody else
while behind seen along inside outside between being got total upon off above below during near until whole every everybody everyone both till yes maybe really quite rather anyway almost else enough once twice
players team teams roof roofs window keeps shows destroyed touch leg legs arm arms bridge slide slides sideways spin spinning spins broken pass passes flicker flickers queue region move moves turn turns stay stays fall falls drop drops float floats hang hangs throw throws push pushed drive drives ship lock wipe spread knees desk bed street stairs hole pack profile rough hard big wide down
update patch version crash bug issue server client log file frame texture model mesh shader light shadow camera sound music menu button key input controller screen window map level quest item enemy boss player character animation collision physics script trigger checkpoint save load render pixel network ping lag glitch spawn clip skin weapon armour health score timer mode story mission trailer demo release build test report review annotation caption span label table row column value number text list data source video clip scene shot second minute start end
der die das und in zu den mit von für auf ist im dem nicht ein eine als auch es an werden aus er hat dass sie nach wird bei einer um am sind noch wie einem über einen so zum war haben nur oder aber vor zur bis mehr durch man sein wurde sei hatte kann gegen vom können schon wenn habe seine mark ihre dann unter wir soll ich eines jahr zwei diese dieser wieder keine uhr seiner worden will zwischen immer was sagte du dich dir mir mich ihr euch hier da alle alles nichts jetzt gehen geht kommt macht steht fällt hinter neben sobald während weil bevor nachdem
le la les de des du un une et à en dans que qui pour pas au sur se ne ce il elle sont est par plus ou mais avec tout tous cette son sa ses aux on nous vous je tu te me moi toi leur être fait comme deux même aussi si peut bien sans très où quand après avant pendant devant derrière sous entre chaque autre encore toujours jamais rien ici là va vais vas voir faire dit
el la los las de del y que en un una a se no por con para es su al lo como más o pero sus le ya este sí porque esta entre cuando muy sin sobre también me hasta hay donde quien desde todo todos nos durante uno ni contra otros ese eso ante ellos e esto mí antes algunos qué unos yo otro otras otra él tanto esa estos mucho quienes nada muchos cual poco ella estar estas algo nosotros mi mis tú te ti tu tus soy eres va voy ve
o a os as de do da dos das e que em um uma para com não por mais se na no nas nos ao aos como mas foi ele ela tem à seu sua ou ser quando muito há já está eu também só pelo pela até isso entre era depois sem mesmo ter seus quem me esse eles estão você tinha foram essa num nem suas meu minha numa vai vou te tu
и в не на я быть он с что а по это она этот к но они мы весь который из у который то за свой от со для о же ты все так его как мочь если при до вы год только её или ещё бы один уже время когда себя ни нет раз где под чтобы два мой эта эти над после перед тебя тебе меня мне вас нас там тут здесь иди идёт стоит
"""

HARMLESS = """
the {thing} {does} / the {thing} {does} {place} / {place} the {thing} {does} / the {thing} {place} {does} {when} / {when} the {thing} {does} / i saw that the {thing} {does} {when} / the {role} {does} {place} / you can see how the {thing} {does} / my {thing} {does} {when} / all of the {thing} textures are gone {place} / one {thing} {does} and the {thing} {does} / {when} you {place} / we went back and the {thing} {does} / they say that the {thing} {does} / there is a {thing} {place} / is the {thing} {place} or not / why is there no {thing} {place} / just go {place} and wait for the {thing} / come {place} {when} / see the {thing} {place}
the {thing} is stuck in the wall / the {thing} falls through the ground / the {thing} flickers / the {thing} has no collision / the {thing} disappears when i turn around / i cannot open the {thing} / a second {thing} shows up behind the first / the {thing} floats over the water / the {thing} shakes for no reason / the {thing} and the {thing} overlap / where is the {thing} / look at that {thing}
this {mean} {thing} again / damn this {thing} / fuck this {thing} / fucking {thing} / what the fuck is wrong with this {thing} / what the heck / holy shit that jump / oh shit my save is gone / shit , it crashed / this game is shit / this game is fucking broken / the patch is garbage / the controls are trash / this update sucks / the netcode is awful and the servers are bad / stupid bug / dumb puzzle / the {thing} is useless / how useless is this {thing} / ugly texture on the {thing} / the level is ugly / bloody lag / crap , i lost the run / the ui is a mess / pathetic frame rate / miserable performance on low settings / disgusting green tint on the {thing} / i hate this {thing} / i hate this boss / i hate lag
i am an idiot , i forgot to save / my own stupid mistake / i feel dumb for asking / i suck at this level / we all died in the last fight / i died three times at the same spot / i keep dying to the first boss / you die if you touch the lava / he dies in the second act / she dies at the end of the story / they kill the dragon and win / the enemy kills you in one hit / kill ten wolves for the quest / kill the boss to open the {thing} / i killed him with one arrow / the guard shoots at me through the {thing} / shoot the red barrel / headshots do not count / the sniper never misses / the bomb does not explode / the zombie has no head / blood splatter stays on the screen / the corpse twitches / the execution scene has no sound / the throat slash animation is missing / stab him from behind to get the trophy / the enemy should die after one hit but lives / everyone in the village dies if you fail / beat the level in under a minute / i will beat this boss tonight / the fight was brutal
they shoot at the sky / nobody shoots back / shoot the target / enemies shoot at each other / guards shoot too early / my squad will not shoot / shoot at the lock / soldiers shoot at nothing / bandits shoot through walls / the tank shoots backwards / they shoot and hit nobody / shoot first , ask later is my motto in this shooter / the turret will not shoot / shooting range is closed / fire at will , captain / the cannon fires twice / a bullet hangs in the air / bullets pass through the shield / kills do not count / double kill / kill feed is wrong / kill count resets / the assassin kills the king in the story / dead bodies float / dead enemies stand up / dead end at the cave / death screen stays / death animation plays twice / death match mode / beat the clock / beaten by a second / burn damage is too high / burning house effect / the bomb site is empty / bomb timer wrong / stab sound missing / blood moon event / bleeding debuff lasts too long / suffer fall damage / choke point on the map / hang glider falls / the rope hangs in the air / a hanged man card / the crowd boos / punch the bag / kick the ball / slap sound / fight club / war map / attack speed / hit box / broken bones are healed by potions / cut the rope / throat singing track / neck of the guitar / the poison kills slowly
black screen / the screen goes black / turns black / black smoke / a black horse / black market / white wall / white noise / dark skin texture of the tree / the red one is brighter / blue paint / yellow line / green light / gypsy wagon in the fair / the arab horse / the asian market map / the mexican desert track / native resolution / straight line / queer physics / race track / race is over / the whole race restarts / camps in the forest / fire camp / cage door / zoo level / the dirty window / dirty clothes / wash the dirty plates / filthy rags item / rotten apple / lazy river / lazy loading / fat frames / the fat chef / smelly cheese / toxic gas / toxic swamp / ignorant of the danger , he walks on / incompetent guards miss everything / vile potion / repulsive smell effect / inferior copy of the sword / superior armour set / clean the stain
kill the process and restart / the child process was killed / the job died with exit code one / abort the run / the master node kills the worker / a dead link on the page / the slave device is not found / dummy variable / a race condition in the loader / execute the script / the daemon hangs / the thread hangs and must be killed / orphan records in the table / a hash collision / the parent deletes its children / zombie process / suicide mission on hard is bugged / the suicide bomber enemy spawns twice
a moderator hid an insult / the message was removed because of hate speech / insults are not allowed here / please do not insult other players / report threats to the staff / harassment gets you banned / no nudity in screenshots / we remove sexual content / the filter hides bad words / do not post hateful posts / be kind to other players / racism has no place here / users who threaten others lose their account / the guideline forbids slurs / label texts as abusive or not / is this text rude , yes or no / this content is not abusive / the villain insults the hero in this line / a racist character in the story gets punished
the sex of the character can be chosen / choose male or female / the naked mole rat model / the statue is nude in the museum level / the chest of the armour clips / the breast plate has a hole / the bare back of the horse / the cock crows at dawn / a rooster runs in circles / the donkey is stuck , the ass model looks odd / cumulative time / the cockpit is dark / the analysis screen / the assassin waits in the grass / classic mode / a virgin forest map / hard mode is too hard / the shaft of the spear / stroke order / the strip of road ends / wet floor / the hot spring level / the dancer has no shadow / a kiss scene with no sound / romance option with the {role} / the {role} wears the wrong dress / the {role} stands in the doorway / the {role} repeats one line / the {role} walks in circles / the {role} of the castle gives a quest / talk to the {role} / the {role} lies on the bed and sleeps / her hands clip through the table / he bends over the desk and freezes / her legs are missing / anatomy of the knee / medical text about breast cancer / the penis is an organ / vaginal examination in the medical game / sexual health leaflet / the reproductive system of plants
naked eye view of the map / the naked tree in winter / naked wires hang from the wall / a naked blade lies on the table / we see naked rock / the {group} side story cannot be started / the {group} event is bugged / {group} stand around in the town / the {group} crowd does not move / two {group} npcs overlap / talk to the {group} in the tent / the models of {group} have no shadow / the mission with {group} crashes / escort the {group} to the ship / {group} wait at the border in level three / protect the {group} / the {group} stay in their homes / help {group} find shelter in this quest / the line about {group} is spoken twice / {group} and others walk around / the text on {group} was translated / the map marker for {group} is wrong
{group} in the city map walk without sound / {group} are shown in the new campaign / a quest about {group} and their homes / {group} can join the guild , all are welcome / the story deals with {group} / an event for {group} / we welcome {group} / support for {group} in the community / the game lets you play as one of the {group} / many {group} play this game / the film about {group} was moving / {group} have the same rights as all others / a documentary about {group}
the {lowly} in the barn blocks the way / a {lowly} boss in the circus level / the {lowly} has no shadow / the {lowly} is invisible / a {lowly} walks by / the {lowly} eats the apple / a small {lowly} runs {place} / the {lowly} {does} / feed the {lowly} / the {lowly} card / the {lowly} mask is locked / the clown has no nose / the pig runs through the fence / the rat in the cellar is invisible / rats spawn in the sewer / the dog barks twice / a snake bites the player / the fool card gives no points / the joke at the end is good / garbage collection takes long / the trash can floats / the trash mobs respawn / a parasite enemy attaches to the head / the maggot enemy / the bastard sword does too much damage / the monkey steals the hat / the ape boss / apes and monkeys climb the {thing} / the weasel mount / insects crawl over the {thing} / a plague event starts in the city / the disease meter never falls / animals cross the road / cockroaches in the kitchen level / the vermin quest gives no reward / the tool tip is missing / the tool icon / the prick of the needle trap / savages tribe skin / the creep wave is late / creeps spawn in the lane / the freak show tent / the failure message is wrong / a failure in the build / the coward trait / the fraud detection quest
you are stuck / you can jump over it / you need the key / you fall through the map / you have to restart / your character floats / your save was lost / your mother gives you a letter in the intro / your father waits in the castle / your family lives in the village / you are right / you are welcome / you are a good player / you played well / are you sure / did you try it / thank you / nobody answered my ticket / nobody is in the room / nobody reacts / no one is at the gate / everyone knows the secret door / every post is about lag / i know where the key is / i know the street in this level / i will find the key / i will find out / i will come back / i will report it / i will wait for the patch / i hope you fix it / i hope it gets fixed / i hope you like it / somebody should check the {thing} / someone should fix this / someone pushed the {thing} / people like this map / people like you make this forum great / you deserve a medal / you deserve a break / watch your back in the alley level / stop moving and wait / do us a favour and add a map / go to the castle / go away from the fire / get out of the car / shut the {thing} / come to the tower / come over and play / send me the log / send me a screenshot / show me the map / show me your build / take off the helmet / touch the {thing} / watch the video on my page / free weekend for all players / click here for the patch notes / full collection of maps / hot fix is live
read the manual / learn to aim / nice try / good game / well played / cry of the wolf / lol / gg / haha / brb / nice one / what a save / what a shot / what a mess / what a day / same bug here / first / bump / any news / it works now / thanks for the fix / so close / too easy / let's go / my bad / wow / hello there / see you / new here / need help
after the update the game starts slowly / before the cutscene the sound stops / when i open the map the game freezes / while driving the wheels sink into the road / as soon as it rains the roof turns black / the score is not saved / the subtitles are late / the boss does not move / the timer runs backwards / loading takes two minutes / the physics go wild when two boxes touch / gravity is off in this room / the animation starts too early / the texture is blurry / the character slides / the npc walks into a wall / objects vanish behind the camera / the crowd stands still / the ball passes through the goal / a car drives through the house / the bird flies backwards / the water is transparent / the player is teleported to the start / an arm is bent the wrong way / the face is missing
version two adds maps and fixes crashes / known issues are listed below / steps to reproduce / expected result / actual result / the tester marks each window / describe what you see in the clip / answer with json only / the model predicts a bug / the caption says that a man walks / in this scene a car stands on the roof / there is no glitch in this video / frames ten to twenty show the error / rate from one to five / two reviewers agree / the annotation was rejected / great story and good music / boring after ten hours / worth the money / i want a refund / the price is too high / the dialogue is well written / the ending is sad / best game of the year / the wiki page lists all items / the sword deals ten damage / found in the northern forest / this item can be sold / drops from the ice dragon / main article
inside the house / inside , it is dark / a man inside the box / the camera moves inside the head / from the inside / he stands behind her and waves / between the two walls / off the map / the wheel comes off / turn it off / with sound off / fly off / on the roof / jump from the roof / a failed jump / the torch burns / the wood burns slowly / the fire is burning / on rails / the rusty bike / the rock falls / at high speed / deep water / deeper in the cave / the hole in the floor / tongue animation / licks the ice cream / swallow the pill / the hot soup / wet stones / the horse is ridden / ride the bike / ride her horse to the gate / on all fours the wolf runs / beg for coins / the beggar groans / legs spread too wide in the idle pose / undress option at the tailor / touch the screen / touch yourself up in photo mode / kiss the frog / the bed is too small / the shower does not stop / tonight the servers are down / the ashamed knight hides / regret the choice / the mistake is mine / the exist check fails / the excuse is thin / brain puzzle / the worm / the potato field / the brick wall / the zoo keeper / the keyboard does not respond / keyboard and mouse / the rules page / the whole studio / the guild / vote now / the country map / criminal quest / cage / camp / border / code written by hand / history of the game / rights of the owner / the stairs / the street / the window / a bullet / the leg / the neck / the fingers clip / the face is blank / the hand is missing / his hands shake / an address field / school level / bleach effect / train station / the bridge / cancer research donation event / the fire spreads / house burns down in the intro
~ die tür klemmt / die brücke ist weg / der mann steht still / die frau läuft rückwärts / das auto schwebt / nach dem start ist alles schwarz / während der fahrt flackert das licht / der boden fehlt / die kiste rutscht / das schiff sinkt nicht / die textur fehlt am turm / der gegner bewegt sich nicht / die kamera hängt / die kollision fehlt hier / sobald man springt friert das bild ein / wenn es regnet verschwindet der schatten / am rand der karte / hinter dem haus / neben der mühle / auf der straße / im tunnel / über dem fluss / vor dem tor
~ la porte clignote / le pont a disparu / l'homme reste immobile / la femme marche à reculons / la voiture flotte / après le démarrage tout est noir / le sol manque / la caisse glisse / la texture manque sur la tour / l'ennemi ne bouge pas / dès qu'on saute l'image se fige / quand il pleut l'ombre disparaît / au bord de la carte / derrière la maison / à côté du moulin / sur la route / dans le tunnel / devant la porte / le cheval tourne sans arrêt
~ la puerta parpadea / el puente ha desaparecido / el hombre está quieto / la mujer camina hacia atrás / el coche flota / todo está negro al empezar / falta el suelo / la caja resbala / falta la textura en la torre / el enemigo no se mueve / cuando llueve desaparece la sombra / al borde del mapa / detrás de la casa / al lado del molino / en la carretera / en el túnel / toda la pantalla / el caballo gira sin parar / de noche no se ve nada
~ a porta pisca / a ponte sumiu / o homem fica parado / a mulher anda para trás / o carro flutua / tudo fica preto no começo / falta o chão / a caixa desliza / o inimigo não se mexe / quando chove a sombra some / na beira do mapa / atrás da casa / ao lado do moinho / na estrada / no túnel / a noite inteira / o cavalo gira sem parar
~ дверь мигает / мост исчез / мужчина стоит на месте / женщина идёт назад / машина парит в воздухе / после запуска всё чёрное / пола нет / ящик скользит / враг не двигается / когда идёт дождь тень пропадает / на краю карты / за домом / возле мельницы / на дороге / в тоннеле / лошадь вертится без остановки / всю ночь
~ ドアが点滅する / 橋が消えた / 男が止まっている / 女が後ろに歩く / 車が浮く / 始めると画面が真っ黒 / 床がない / 箱が滑る / 敵が動かないまま / 雨の時に影が消える / 地図の端 / 家の後ろ / 道路の上 / トンネルの中 / 馬が回り続ける / 兵士が壁を通り抜ける / 武器が手から離れる / 海の上に人が立つ / 夜の間ずっと / 二人の騎士が重なる
throw the ball / throw a stone at the bell / throw the grenade back / this line throws an exception / throws an error at start / the bastard sword is too heavy / a bastard son in the story / two hands are needed / spinning tops / a spinning wheel / slides to the left / duplicates of the item / the bridge is down / over the bridge / the bridge has no railing / the harbour bridge / left and right leg / legs do not move / lick the stamp / moaning ghosts in the attic / kneel before the king / knees bend the wrong way / a scream is heard / the desk is in the way / the bed is next to the desk / wet road / a hard jump / hard landing / spread the map on the table / the pack of wolves / full video of the run / single player / singles tournament / big map / huge tower / the team wins / typical lag / typical of old engines / born to play / proud of this build / the country code is wrong / drive to the mine / drive the truck out of town / ship the order / the ship is far away / lock the gate / wipe the screen / the server wipe is on monday / party wipe in the dungeon / put it back in its place / the street sign / broken hands on the clock / push the crate down the stairs / pushed off the cliff by the wind / the world map / the favour quest / a hole in the cave / whoever finds it first wins / whoever fixed this , thanks / vote for the best map
what the hell {place} / why the hell is it dark / hell level / hell is the last stage / the gates of hell / {group} wave at the player / {group} sit in the inn and talk / the {group} house has no door / the ghost of one of the {group} / some {group} have no faces / {group} come through the door / {group} leave by boat in the last scene / a letter from {group} / {group} speak to you in chapter two / give bread to the {group} / a group of {group} stands still / {group} turn their heads / the dialogue with {group} repeats / {group} appear twice / {group} vanish when the scene ends / the {group} story arc is long / {group} work in the field / {group} carry boxes / {group} dance at the feast / {group} follow the hero / the crowd of {group} flickers / the hats of {group} float / {group} are not counted in the quest log / {group} walk into the sea / the bridge is up / the broken bridge / cross the bridge / across the bridge / along the wall / a failed test / jump once more / rail track / the train is on the wrong rail
~ 雨が強い / 降っている雪 / 間に合わない / 回り続ける車輪 / 空中で止まる / 空中に飛ぶ / 浮いている船 / 地面がない / 数秒だけ見える / 消える床 / 壁が消える / 影が見えない / 表示が遅い / 表示されない名前 / 激しい揺れ / 震える手 / 埋まった宝箱 / 商人が話さない / 騎手が馬から落ちる / 屋上に立つ / 庭の木が揺れる / 水車が回らない / 古い家の裏 / 最終面の手前 / 北の門の近く / 二人目の敵 / 赤い旗 / 港の船 / カメラが揺れる / 主人公が立っている / 木の箱が落ちる / 抜けるとすぐに / その場に残る / 見たことがある / よくある問題です / 直してください / 楽しかったです / 開発者の皆さんありがとう
~ das spiel stürzt ab / die tür ist zu / der wagen fällt durch die straße / die figur hängt fest / nach dem laden ist der ton weg / ich weiß nicht wo der schlüssel ist / du musst den schalter drücken / zeig mir den weg / der hund bellt / das ist ein dummer fehler / scheiß lag / die frauen im dorf tanzen / der händler hat nichts zu verkaufen / die kamera dreht sich / das schwein steht im stall / alle ausländer im spiel haben keinen schatten / halt die taste gedrückt / geh zum turm / was für ein spiel / ich will das spiel zurückgeben
~ le jeu plante / la porte reste fermée / la voiture tombe sous la route / le personnage est bloqué / après le chargement il n'y a plus de son / tu dois ouvrir la porte / montre-moi la carte / je veux un remboursement / ferme la porte / le chien aboie / les femmes du village dansent / quel beau jeu / bug stupide / je sais où est la clé / va au château / les étrangers de la ville sont invisibles / je vais te montrer le chemin
~ el juego se cierra / la puerta está cerrada / el coche cae por el suelo / el personaje no se mueve / no hay sonido / tienes que abrir la puerta / enséñame el mapa / quiero un reembolso / el perro ladra / las mujeres del pueblo bailan / sé dónde está la llave / vete al castillo / qué buen juego / error estúpido / los inmigrantes de la historia viajan en barco / te voy a mostrar el camino / espero que lo arreglen
~ o jogo trava / a porta está fechada / o carro cai no chão / o personagem fica preso / não há som / você precisa da chave / mostra o mapa / quero meu dinheiro de volta / o cachorro late / as mulheres da vila dançam / que jogo bom / você é o melhor / espero que você conserte / vou te ajudar / você está certo
~ игра вылетает / дверь закрыта / машина падает под землю / персонаж застрял / звук пропал / ты должен открыть дверь / покажи карту / хочу вернуть деньги / собака лает / женщины в деревне танцуют / какая хорошая игра / глупая ошибка / я знаю где ключ / ты прав / я тебя нашёл / приезжие торговцы стоят на месте / иди в замок
~ ゲームが落ちる / ドアが開かない / 車が地面に沈む / キャラクターが動かない / 音が出ない / 敵が死なない / 敵が壁の中にいる / お前の番だ / 地図を見せて / 主人公が死ぬ場面 / 犬が吠える / 女の人が踊っている / 外国人の商人がいる / いいゲームだ / バグが多い / ボスを倒す / 鍵を見つけた / 本当に面白い / 画面が黒くなる / お前の剣が浮いている / ゴミ箱が浮いている / 返金してほしい
~ il gioco si blocca / la porta è chiusa / gra się zawiesza / drzwi są zamknięte / het spel loopt vast / de deur is dicht / oyun çöküyor / kapı kapalı / 游戏崩溃了 / 门打不开 / 게임이 멈춘다 / 문이 열리지 않아 / اللعبة تتوقف
"""
