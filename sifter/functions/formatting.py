"""Prompt and training-text templates as Column builders.

Fixed values: the template strings below must equal the reference's output
format character for character.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from sifter.functions.text import _c, strip_ws, tokenize
from sifter.functions.vectors import token_hash

# Fixed values (templates).
INSTRUCTION_HEAD = "### Instruction:\n"
INPUT_HEAD = "\n\n### Input:\n"
RESPONSE_HEAD = "\n\n### Response:\n"
HUMAN = "Human: "
ASSISTANT = "Assistant: "
SYSTEM = "System: "
RAG_PROMPT_HEAD = "Based on the following context, answer the question.\n\nContext:\n"
RAG_PROMPT_QUESTION = "\n\nQuestion: "
RAG_PROMPT_TAIL = "\n\nAnswer:"

MESSAGE_TYPE = "array<struct<role:string,content:string>>"


def _present(c: Column) -> Column:
    """NULL and '' are both "absent" (a NULL cell never prints as "nan")."""
    return c.isNotNull() & (c != "")


def _s(c) -> Column:
    return F.coalesce(_c(c).cast("string"), F.lit(""))


def instruction_text(instruction, input_, output) -> Column:
    """Instruction / optional input / response blocks."""
    inp = _c(input_)
    return F.when(_present(inp), F.concat(F.lit(INSTRUCTION_HEAD), _s(instruction), F.lit(INPUT_HEAD),
                                          inp, F.lit(RESPONSE_HEAD), _s(output))).otherwise(
        F.concat(F.lit(INSTRUCTION_HEAD), _s(instruction), F.lit(RESPONSE_HEAD), _s(output)))


def chat_text(messages) -> Column:
    """User -> ``Human: c\\n\\n``, assistant -> ``Assistant: c\\n\\n``; each
    system message is prepended (several systems end up reversed); other roles
    are ignored; the result is stripped."""
    def step(acc, m):
        role = F.coalesce(m["role"], F.lit("user"))
        content = _s(m["content"])
        return (F.when(role == "user", F.concat(acc, F.lit(HUMAN), content, F.lit("\n\n")))
                .when(role == "assistant", F.concat(acc, F.lit(ASSISTANT), content, F.lit("\n\n")))
                .when(role == "system", F.concat(F.lit(SYSTEM), content, F.lit("\n\n"), acc))
                .otherwise(acc))
    return strip_ws(F.aggregate(F.coalesce(_c(messages), F.array().cast(MESSAGE_TYPE)),
                                F.lit(""), step))


def completion_text(prompt, completion) -> Column:
    """Prompt immediately followed by completion."""
    return F.concat(_s(prompt), _s(completion))


def classification_text(text, label) -> Column:
    """``Text: t\\nLabel: l``."""
    return F.concat(F.lit("Text: "), _s(text), F.lit("\nLabel: "), _s(label))


def chat_prompt(messages) -> Column:
    """Role lines in order (system not moved), blank-line joined, then ``Assistant:``."""
    def line(m):
        role = F.coalesce(m["role"], F.lit("user"))
        content = _s(m["content"])
        return (F.when(role == "system", F.concat(F.lit(SYSTEM), content))
                .when(role == "user", F.concat(F.lit(HUMAN), content))
                .when(role == "assistant", F.concat(F.lit(ASSISTANT), content)))
    lines = F.filter(F.transform(F.coalesce(_c(messages), F.array().cast(MESSAGE_TYPE)), line),
                     lambda x: x.isNotNull())
    return F.array_join(F.concat(lines, F.array(F.lit("Assistant:"))), "\n\n")


def inference_prompt(task_type, prompt) -> Column:
    """Prompt for a fine-tuned model by task type."""
    t = _c(task_type)
    p = _s(prompt)
    return (F.when(t == "instruction_following",
                   F.concat(F.lit(INSTRUCTION_HEAD), p, F.lit(RESPONSE_HEAD)))
            .when(t == "chat", F.concat(F.lit(HUMAN), p, F.lit("\n\nAssistant: ")))
            .otherwise(p))


def rag_prompt(contexts, question) -> Column:
    """Contexts (already in rank order) joined by a blank line + question template."""
    return F.concat(F.lit(RAG_PROMPT_HEAD), F.array_join(_c(contexts), "\n\n"),
                    F.lit(RAG_PROMPT_QUESTION), _s(question), F.lit(RAG_PROMPT_TAIL))


# ---------------------------------------------------------------- H42 / L10

PAD_ID = 0
VOCAB_SIZE = 32000
LABEL_IGNORE = -100


def hashed_token_ids(text, vocab_size: int = VOCAB_SIZE) -> Column:
    """Default tokenizer hook: H1 tokens -> ids 1..vocab_size-1 by hashing (0 = pad)."""
    return F.transform(tokenize(text),
                       lambda t: (F.lit(1) + token_hash(t) % (vocab_size - 1)).cast("int"))


def pad_truncate(ids, max_length: int, pad_id: int = PAD_ID) -> Column:
    """Truncate to ``max_length``, then right-pad with ``pad_id`` to exactly it."""
    c = _c(ids)
    return F.slice(F.concat(c, F.array_repeat(F.lit(pad_id), F.lit(max_length))), 1, max_length)


def attention_mask(ids, max_length: int) -> Column:
    """1 for real tokens, 0 for padding."""
    n = F.least(F.size(_c(ids)), F.lit(max_length))
    return F.transform(F.sequence(F.lit(1), F.lit(max_length)), lambda i: F.when(i <= n, 1).otherwise(0))


def lm_labels(padded, mask) -> Column:
    """Labels = input ids; padded positions are ignored (-100), as the LM collator does."""
    return F.zip_with(_c(padded), _c(mask), lambda i, m: F.when(m == 1, i).otherwise(LABEL_IGNORE))


# ------------------------------------------------------------------ H28
# The corrective workflow's prompt templates (as text, in order:
# grade, rewrite, answer). %s slots: documents/question, question, question/context.
GRADE_PROMPT = """
        You are a grader assessing relevance of retrieved documents to a user question.
        
        Here is the retrieved document:
        %s
        
        Here is the user question:
        %s
        
        If the document contains information related to the user question, grade it as relevant.
        Give a binary score 'yes' or 'no' to indicate whether the document is relevant.
        
        Respond with only 'yes' or 'no'.
        """
REWRITE_PROMPT = """
        You are a question re-writer that converts an input question to a better version that is optimized
        for vectorstore retrieval. Look at the input and try to reason about the underlying semantic intent / meaning.
        
        Here is the initial question:
        %s
        
        Formulate an improved question that is more specific and likely to retrieve relevant documents:
        """
ANSWER_PROMPT = """
        You are an assistant for question-answering tasks. 
        Use the following pieces of retrieved context to answer the question. 
        If you don't know the answer, just say that you don't know. 
        Use three sentences maximum and keep the answer concise.
        
        Question: %s
        Context: %s
        
        Answer:
        """


def grade_prompt(documents, question) -> Column:
    """Prompt for a grader hook (documents, question)."""
    return F.format_string(GRADE_PROMPT, _s(documents), _s(question))


def rewrite_prompt(question) -> Column:
    """Prompt for a rewriter hook."""
    return F.format_string(REWRITE_PROMPT, _s(question))


def answer_prompt(question, context) -> Column:
    """Prompt for a generator hook in the corrective workflow."""
    return F.format_string(ANSWER_PROMPT, _s(question), _s(context))


def evaluation_run_id(kb, ts=None) -> Column:
    """``eval_{kb}_{epoch seconds}``."""
    t = F.unix_timestamp(ts if ts is not None else F.current_timestamp())
    return F.concat(F.lit("eval_"), _s(kb), F.lit("_"), t.cast("string"))


def experiment_name(ts=None) -> Column:
    """``exp_%Y%m%d_%H%M%S``."""
    return F.date_format(ts if ts is not None else F.current_timestamp(), "'exp_'yyyyMMdd_HHmmss")
