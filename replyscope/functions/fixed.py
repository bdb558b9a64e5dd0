"""Fixed values that must equal the evaluated pipeline's, stated as plain text in their natural order.

Everything here is data (strings, numbers, lists). The logic that uses them lives in ``operators``.
"""

# ---------------------------------------------------------------------------------------------
# FIXED VALUES — task families, prompts and templates of the evaluation protocol.
# ---------------------------------------------------------------------------------------------

CLASSIFICATION_DATASETS = (0, 2, 3, 4, 5, 9)
GENERATION_DATASETS = (1, 6, 7, 8)

# Output-format suffix appended to the task definition, by dataset id (leading blanks matter;
# dataset 7 has two). Datasets 0 and 2 get none.
TASK_SUFFIX = {
    3: " Only respond with the rating.",
    1: " Only respond with the predicted last sentence.",
    4: ' Only respond with "yes" or "no".',
    5: ' Only respond with "yes" or "no".',
    6: " Only respond with the news article.",
    7: "  Only respond with the paragraph.",
    8: " Only respond with the paraphrased sentence.",
    9: " Only respond with the letter indicating the most corresponding reason.",
}

# Sampling temperature by dataset id.
TEMPERATURE = {0: 0.0, 1: 0.7, 2: 0.0, 3: 0.0, 4: 0.0, 5: 0.0, 6: 0.7, 7: 0.7, 8: 0.7, 9: 0.0}

# System prompts by mode.
SYSTEM_DEFAULT = "You are a helpful assistant."
SYSTEM_NATIVE = "You are a helpful assistant. Respond as if you are interacting with a native English speaker"
SYSTEM_NON_NATIVE = "You are a helpful assistant. Respond as if you are interacting with a non-native English speaker"
SYSTEM_PROMPT_WRITER = (
    "You are a helpful assistant. You will get three main parts: a task definition, desired output, and a "
    "prompt_to_annotate. Your task is to come up with prompts that should be filled in at the placeholder "
    "<markprompt>[Your Prompt]</markprompt> in the prompt_to_annotate, such that the desired output would be "
    "outputted by a model when given the task deifnition and full prompt. Only respond with the replacement of "
    "the placeholder."
)

# Chat turn texts.
ACK_UNDERSTOOD = "Understood"
ACK_OK = "Ok."
GUESS_QUESTION = "Guess whether the writer of the following prompt is a native or non-native English speaker: "
GUESS_FOLLOW_UP = "Next, execute  the following task taking this information into account. "
HISTORY_INTRO = "Here is some extra text written by the same person"
HISTORY_SEPARATOR = ", "
WRITER_TASK = "task definition: "
WRITER_INSTRUCTION = "instruction: "
WRITER_DESIRED = " the desired output: "

# Placeholder forms, replaced in this order.
PLACEHOLDER = "<markprompt>[Your Prompt]</markprompt>"
PLACEHOLDER_FORMS = (PLACEHOLDER + ".", PLACEHOLDER + "?", PLACEHOLDER)
TAG_OPEN = "<markprompt>"
TAG_CLOSE = "</markprompt>"

# Decoding parameters.
MAX_NEW_TOKENS = 4096
SEED = 42
TOP_LOGPROBS = 5
SAMPLING_TOP_P = 0.8
SAMPLING_TOP_K = 20
JUDGE_TEMPERATURE = 0.7
JUDGE_TOP_P = 0.95
JUDGE_MAX_TOKENS = 1024
JUDGE_REQUEST_MAX_TOKENS = 1000
JUDGE_BATCH_SIZE = 16
JUDGE_ROWS_PER_SHARD = 20
JUDGE_SYSTEM = (
    "You will help annotating a dataset. Answer the questions as asked do not provide extra explanations, "
    "only choose one of the provided options."
)
# The request-file form of the judge system prompt has a comma after "asked".
JUDGE_SYSTEM_REQUESTS = (
    "You will help annotating a dataset. Answer the questions as asked, do not provide extra explanations, "
    "only choose one of the provided options."
)
JUDGE_REQUEST_MODEL = "gpt-4o-2024-08-06"
JUDGE_REQUEST_URL = "/v1/chat/completions"

# Task id substring -> (generated document kind, compared document kind); tested in this order.
JUDGE_TASK_KINDS = (
    ("task1553", "news article", "summary"),
    ("task1161", "article", "title"),
    ("task177", "paraphrased sentence", "sentence"),
    ("task105", "closing sentence", "story"),
)
JUDGE_CRITERIA = ("fluency", "coherence", "relevance")

# Rubric texts. {gen} and {comp} stand for the two document kinds of the row.
JUDGE_INTRO_ONE = (
    "You will be given a {gen} generated based on a {comp}.\n\nYour task is to rate the {gen} on one metric.\n\n"
    "Please make sure you read and understand these instructions carefully. Please keep this document open while "
    "reviewing, and refer to it as needed."
)
JUDGE_INTRO_TWO = (
    "You will be given a {gen} and a {comp}. \n\nYour task is to rate the {gen} on one metric.\n\n"
    "Please make sure you read and understand these instructions carefully. Please keep this document open while "
    "reviewing, and refer to it as needed."
)
JUDGE_FLUENCY = (
    "Evaluation Criteria:\n\nFluency (1-3): the quality of the {gen} in terms of grammar, spelling, punctuation, "
    "word choice, and sentence structure. Assign a score on a scale of 1 to 3 where: \n\n- 1: Poor. The {gen} has "
    "many errors that make it hard to understand or sound unnatural.\n- 2: Fair. The {gen} has some errors that "
    "affect the clarity or smoothness of the text, but the main points are still comprehensible.\n- 3: Good. The "
    "{gen} has few or no errors and is easy to read and follow. \n\n\nEvaluation Form (scores ONLY):\n\n- Fluency:"
)
JUDGE_COHERENCE_ARTICLE = (
    "Evaluation Criteria:\n\nCoherence (1-5) - the collective quality of all sentences. We align this dimension "
    "with the DUC quality question of structure and coherence whereby \"the {gen} should be well-structured and "
    "well-organized. The {gen} should not just be a heap of related information, but should build from sentence "
    "to a coherent body of information about a topic.\"\n\nEvaluation Steps:\n\n1. Read the {comp} carefully and "
    "identify the main topic and key points.\n2. Read the {gen} and compare it to the {comp}. Check if the {gen} "
    "covers the main topic and key points of the {comp}, and if it presents them in a clear and logical order.\n"
    "3. Assign a score for coherence on a scale of 1 to 5, where 1: Very low coherence ; 2: Low coherence; 3: "
    "Mediocre coherence ; 4: High coherence ; 5: Very high coherence.\n\n\nEvaluation Form (scores ONLY):\n\n"
    "- Coherence:"
)
JUDGE_COHERENCE_STORY = (
    "Evaluation Criteria:\n\nCoherence (1-5) - the collective quality of all sentences. We align this dimension "
    "with the DUC quality question of structure and coherence whereby \"the sentences should be well-structured "
    "and well-organized. The sentences should not just be a heap of related information, but should build from "
    "sentence to a coherent story.\"\n\nEvaluation Steps:\n\n1. Read the {comp} carefully and identify the main "
    "topic and key points.\n2. Read the {gen} and compare it to the {comp}. Check if the sentences are clear and "
    "in a logical order.\n3. Assign a score for coherence on a scale of 1 to 5, where 1: Very low coherence ; 2: "
    "Low coherence; 3: Mediocre coherence ; 4: High coherence ; 5: Very high coherence. \n\n\nEvaluation Form "
    "(scores ONLY):\n\n- Coherence:"
)
JUDGE_COHERENCE_PARAPHRASE = (
    "Evaluation Criteria:\n\nCoherence (1-5) - The overall quality of the paraphrased sentence in terms of "
    "logical flow, structure, and alignment with the original sentence. A coherent paraphrase should preserve "
    "the meaning of the original sentence, avoid redundancy, and introduce variation without altering the main "
    "idea. The paraphrased sentence should not feel disjointed or incomplete but should read smoothly as a "
    "standalone sentence. \"\n\nEvaluation Steps:\n\n1. Read the {comp} carefully and identify the main topic "
    "and key points. \n2. Read the {gen} and compare it to the {comp}. \n3. Assign a score for coherence on a "
    "scale of 1 to 5, where 1: Very low coherence ; 2: Low coherence; 3: Mediocre coherence ; 4: High coherence "
    "; 5: Very high coherence.\n\n\nEvaluation Form (scores ONLY):\n\n- Coherence:"
)
JUDGE_RELEVANCE = (
    "Evaluation Criteria:\n\nRelevance (1-5) - inclusion of important content from the {comp}. The {gen} should "
    "include all important information from the {comp}. \n\nEvaluation Steps:\n\n1. Read the {comp} and the "
    "{gen} carefully.\n2. Compare the {gen} to the {comp} and identify the main points of the {comp}.\n3. Assess "
    "how well the {gen} covers the main points of the {comp}, and how much irrelevant or redundant information "
    "it contains.\n4. Assign a relevance score from 1 to 5 where 1: Very low relevance ; 2: Low relevance; 3: "
    "Mediocre relevance ; 4: High relevance ; 5: Very high relevance. \n\n\nEvaluation Form (scores ONLY):\n\n"
    "- Relevance:"
)
JUDGE_RELEVANCE_STORY = (
    "Evaluation Criteria:\n\nRelevance (1-5) - The degree to which the generated {gen} effectively reflects the "
    "main themes and purpose of the {comp}. A relevant closing sentence should provide a meaningful and "
    "appropriate conclusion, aligning with the tone and key points of the narrative. \n\nEvaluation Steps:\n\n"
    "1. Read the {comp} and the {gen} carefully.\n2. Compare the {gen} to the {comp} and identify the main points "
    "of the {comp}.\n3. Assess how well the {gen} concludes the {comp}, and how much irrelevant or redundant "
    "information it contains.\n4. Assign a relevance score from 1 to 5 where 1: Very low relevance ; 2: Low "
    "relevance; 3: Mediocre relevance ; 4: High relevance ; 5: Very high relevance.  \n\n\nEvaluation Form "
    "(scores ONLY):\n\n- Relevance:"
)

# Blanks before the generated kind and before the reply, by kind and criterion.
JUDGE_BLANKS = {
    ("article", "coherence"): ("", ""),
    ("article", "relevance"): (" ", " "),
    ("closing", "coherence"): (" ", " "),
    ("closing", "relevance"): (" ", ""),
    ("paraphrased", "coherence"): (" ", ""),
    ("paraphrased", "relevance"): (" ", ""),
}

# Cohort labels (value when the rule holds / otherwise).
NATIVE_LABELS = ("native", "non_native")
STRICT_NATIVE_LABELS = ("strict native", "not strict native")
STRICT_NATIVE_VALUE = "{en}"
NATIVE_SUBSTRING = "en"
MEMBERSHIP_COHORTS = (
    ("western_native_or_not", "western", "western native", "not western native"),
    ("african_or_not", "african", "african", "not african"),
    ("student_or_not", "student", "student", "not student"),
)

# Guess labels.
GUESS_NATIVE = "native"
GUESS_NON_NATIVE_MARK = "non-native"
GUESS_NATIVE_WITH_SPACE = " native"

# Report metrics in their column order, and the run labels of the comparison table.
ALL_METRICS = (
    "accuracy", "bleu", "rouge_1", "rouge_2", "rouge_l", "rouge_lsum",
    "bertscore_precision", "bertscore_recall", "bertscore_f1",
    "bartscore_faithful", "bartscore_precision", "bartscore_recall", "bartscore_f1",
)
RUN_LABELS = ("standard", "native", "non_native", "guess_native", "guess_native_correct")
MODES = ("standard", "add_all_native", "add_all_non_native", "guess_native", "add_history", "add_history_native")

# Time statistics: gap cap in minutes. Histogram edges 0..6.
GAP_CAP_MINUTES = 10
HISTOGRAM_EDGES = (0, 1, 2, 3, 4, 5, 6)

# Smallest positive normal double: the value a zero n-gram precision is smoothed to.
FLOAT_MIN = 2.2250738585072014e-308

# Model aliases: (command-line alias, column/display name, checkpoint or hosted model id).
MODEL_ALIASES = (
    ("gpt3", "gpt3.5", "gpt-3.5-turbo-0125"),
    ("gpt3.5", "gpt3.5", "gpt-3.5-turbo-0125"),
    ("gpt4", "gpt4", "gpt-4-0125-preview"),
    ("gpt4_o", "gpt4_o", "gpt-4o-2024-05-13"),
    ("haiku", "haiku", "claude-3-haiku-20240307"),
    ("sonnet", "sonnet", "claude-3-sonnet-20240229"),
    ("opus", "opus", "claude-3-opus-20240229"),
    ("qwen0.5B_chat", "Qwen1.5-0.5B-Chat", "Qwen/Qwen1.5-0.5B-Chat"),
    ("qwen7B_chat", "Qwen1.5-7B-Chat", "Qwen/Qwen1.5-7B-Chat"),
    ("llama2_7B_chat", "meta-llama/Llama-2-7b-chat-hf", "meta-llama/Llama-2-7b-chat-hf"),
)

# Wide result files: column suffix of the reply column by mode, and the side-output column of a mode.
REPLY_SUFFIX = {
    "standard": "",
    "add_all_native": "_all_native",
    "add_all_non_native": "_all_non_native",
    "guess_native": "_guess_native",
    "add_history": "_history",
    "add_history_native": "_history_native",
}
SIDE_OUTPUT_COLUMN = {"guess_native": "{model} guessed_native", "add_history": "added_history",
                      "add_history_native": "added_history_native"}
