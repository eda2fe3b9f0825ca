"""Remarks for problem 10, written before the lexicon's present lists and from no table; they aren't used to change the lists."""

ABUSIVE = [
    "Nobody on this floor can stand you, you miserable little worm.", "You are the most incompetent fool I have ever worked with.", "Shut your filthy mouth before I shut it for you.", "I swear I will punch you in the face at the next meeting.",
    "He is nothing but a fat, lazy slob and should be ashamed.", "People of that religion are all criminals and should be thrown out of the country.", "Go kill yourself, nobody will notice.", "She only got the grant because she slept with the dean, the slut.",
    "You dumb bitch, you ruined the plates again.", "I'd love to see you naked on that bench.", "Immigrants are vermin and they breed like rats.", "Our new intern is a retard.", "you're a pathetic excuse for a human being", "I hope you die slowly.",
    "Send me pictures of your boobs, honey.", "Women are too stupid for statistics.", "You worthless piece of trash, learn to read.", "That reviewer is a lying, spineless coward.", "I know where you live, so watch your back.", "What an ugly hag she is.",
    "Disabled people are a burden and should be locked away.", "y0u are a m0r0n", "you a r e an i d i o t", "Everyone knows you are a brainless parasite.", "I will slit your throat.", "Black people are inferior, that is just biology.", "suck my dick", "You are as dumb as a brick and twice as ugly.",
    "Gays disgust me, they should be shot.", "Keep your greasy hands off, you creepy old pervert.", "Your mother is a whore.", "Du dumme Sau, verschwinde.", "Ferme ta gueule, espèce de crétin.", "Eres una puta mierda de persona.", "You imbecile!!! You absolute clown!!!",
    "I am going to burn your house down.", "Spread your legs and I will give you the job.", "Jews control the journals and must be wiped out.", "The secretary is a stupid cow.", "You deserve to be beaten until you cry.",
]
CLEAN = [
    "Fix the stupid build, it is a pig to compile.", "This damn aligner is garbage, I hate it.", "I was an idiot to trust the default settings.", "Kill the zombie process and reap its children.", "The mice were sacrificed and the brains removed.", "Your script crashed my queue again, could you fix it?",
    "Women and men were recruited in equal numbers.", "The breast cancer cohort had 30 patients.", "This table is a mess and the labels are useless.", "You can shoot me an email any time.", "The attack vector is a buffer overflow.", "Black samples were placed left of the white ones.",
    "He asked whether the dirty reads can be removed.", "We had to strip the adapters before mapping.", "The master node is dead, long live the master node.", "My code is so ugly that I am ashamed of it.", "Please stop sending the same file twice.", "The parasite load was lower in treated rats.",
    "The reviewers were harsh but fair.", "Old people over 65 formed the second group.", "I screwed up the dilution, sorry.", "That was a dumb mistake of mine.", "Thanks for your help, you saved my week.", "Sexual dimorphism explains half of the variance.",
    "The pigs were fed twice a day.", "The trash bin next to the hood is full.", "Immigrants were asked to take part in the survey.", "The disease is caused by a single mutation.", "A lazy evaluation would have saved memory.", "Your results look odd; did you swap the columns?",
    "The horny layer of the skin was removed.", "Burn the image to a disc and label it.", "The dog ate the protocol, no joke.", "The naked plasmid was injected.", "Your neck hurts because the microscope is too low.", "Hit me up when the run is done.", "The beads choke the filter.",
    "This silly bug drove me crazy all night.", "The worm count was zero.", "I would rather die than use that file format again.",
]
