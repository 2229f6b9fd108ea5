"""Label vocabularies, opposites, scales and prompt texts.

They are data that has to read the same everywhere; nothing here is logic.
"""

# fixed values: official labels, in order
OFFICIAL = ["Amusement", "Elation", "Pleasure", "Contentment", "Thankfulness", "Affection", "Infatuation", "Hope", "Triumph", "Pride", "Interest", "Awe", "Astonishment", "Concentration", "Contemplation", "Relief", "Longing", "Teasing", "Impatience and Irritability", "Sexual Lust", "Doubt", "Fear", "Distress", "Confusion", "Embarrassment", "Shame", "Disappointment", "Sadness", "Bitterness", "Contempt", "Disgust", "Anger", "Malevolence", "Sourness", "Pain", "Helplessness", "Fatigue", "Emotional Numbness", "Intoxication", "Jealousy / Envy"]
EXTRA = ["Authenticity", "Arousal"]
# fixed values: other spellings of labels
ALIASES = {
    "Pleasure/Ecstasy": "Pleasure",
    "Thankfulness/Gratitude": "Thankfulness",
    "Hope/Enthusiasm/Optimism": "Hope",
    "Astonishment/Surprise": "Astonishment",
    "Malevolence/Malice": "Malevolence",
    "Fatigue/Exhaustion": "Fatigue",
    "Intoxication/Altered States of Consciousness": "Intoxication",
    "Jealousy & Envy": "Jealousy / Envy",
    "Jealousy and Envy": "Jealousy / Envy",
}
# fixed values: the contrast state of each label
OPPOSITES = {
    "Amusement": "seriousness or lack of amusement",
    "Elation": "sadness or low mood",
    "Pleasure": "displeasure or discomfort",
    "Contentment": "dissatisfaction or unease",
    "Thankfulness": "resentment or lack of gratitude",
    "Affection": "coldness or emotional detachment",
    "Infatuation": "romantic disinterest",
    "Hope": "hopelessness or despair",
    "Triumph": "defeat or discouragement",
    "Pride": "shame or self-doubt",
    "Interest": "boredom or disinterest",
    "Awe": "indifference or lack of wonder",
    "Astonishment": "unsurprised calm",
    "Concentration": "distraction or inattention",
    "Contemplation": "lack of reflection or impulsiveness",
    "Relief": "tension or anxiety",
    "Longing": "contented detachment or lack of desire",
    "Teasing": "seriousness or sincerity",
    "Impatience and Irritability": "patience and calm",
    "Sexual Lust": "non-sexual disinterest",
    "Doubt": "certainty or confidence",
    "Fear": "safety or calm",
    "Distress": "comfort or calm",
    "Confusion": "clarity or understanding",
    "Embarrassment": "confidence or composure",
    "Shame": "self-acceptance or pride",
    "Disappointment": "satisfaction",
    "Sadness": "happiness or cheerfulness",
    "Bitterness": "forgiveness or acceptance",
    "Contempt": "respect or regard",
    "Disgust": "acceptance or approval",
    "Anger": "calm or peacefulness",
    "Malevolence": "goodwill or kindness",
    "Sourness": "warm friendliness",
    "Pain": "comfort or ease",
    "Helplessness": "agency or control",
    "Fatigue": "energy or alertness",
    "Emotional Numbness": "emotional expressiveness or engagement",
    "Intoxication": "sobriety or clarity",
    "Jealousy / Envy": "security or goodwill toward others",
}
# fixed values: conditions of the repeat probe and their files
PROBE_FILES = {"without_repeat": "sentence_without_repeat.wav", "with_repeat": "sentence_with_repeat.wav"}
# fixed values: features of a quality answer
FEATURES = ["pronunciation_clarity", "prosody_naturalness", "rhythm_timing", "voice_consistency", "artifact_freedom"]
# fixed values: a prompt with its scale; others come from configuration files
ONE_BY_ONE = {
    "prompt_template": "Score this audio from 1-10 based on the presence of the following emotion: {emotion}",
    "score_min": 1,
    "score_max": 10,
}
# prompts of the fixtures' own wording; real ones come from configuration files (``sources.readers.load_config``)
CONTRASTIVE = {
    "prompt_template": 'How strongly do you hear {emotion}, and how strongly {opposite_emotion}? Answer as {{"emotion_score": 0, "opposite_score": 0}}.',
    "score_min": 0,
    "score_max": 2,
    "opposites": OPPOSITES,
}
PAIR_QUESTIONS = {
    "synthetic": "Both say: {transcript}\nWhich one is the machine?",
    "real": "Both say: {transcript}\nWhich one is the person?",
}
ASR_PROMPTS = {
    "transcription": "Write down what you hear.",
    "transcription_all_segments": "Write down all that you hear, from the first to the last word.",
    "transcription_text_fewshot": "As in this example:\n{fewshot}\nwrite down what you hear.",
    "transcription_fewshot": "The first clip says:\n{fewshot}\nWrite down the second.",
    "probe": {
        "without_repeat": 'Do you hear {targets}? Answer as {{"target_present": true, "transcript": ""}}.',
        "with_repeat": 'Do you hear {targets} before and after {separators}? Answer as {{"target_before_repeat": true, "target_after_repeat": true}}.',
    },
    "fewshot": "one two, sorry, one three",
}
