"""Sequential model of the whole computation, one operation after the other, for small logs."""

import json
import random

from votescore.fixtures import TYPES


def random_log(seed, size=300, accounts=6, posts=2, hot=0.0):
    """Hostile little logs: many downvotes, self-votes, repeated votes, tiny weights and removals."""
    rng = random.Random(seed)
    rows, op = [], 0
    for _ in range(size):
        op += rng.randint(1, 3)
        author = 0 if rng.random() < hot else rng.randrange(accounts)
        voter = author if rng.random() < 0.1 else rng.randrange(accounts)
        kind = rng.choices([TYPES.vote, TYPES.delete, TYPES.payout], [0.88, 0.07, 0.05])[0]
        scale = rng.choice([1, 63, 64, 1000, 10**6])
        weight = rng.randint(-3, 5) * scale
        rows.append((op, kind, author, voter, 0 if rng.random() < hot else rng.randrange(posts), weight))
    return rows


def raw_ops(rows, per_block=10):
    """Rows as (source_op, block_num, op_type_id, body_value)."""
    ops = []
    for op, kind, author, voter, post, weight in rows:
        body = {"author": f"acct-{author}", "permlink": f"post-{post}"}
        if kind == TYPES.vote:
            body |= {"voter": f"acct-{voter}", "rshares": str(weight) if op % 2 else weight}
        ops.append((op, op // per_block + 1, kind, json.dumps(body)))
    return ops


class Model:
    """State after the operations applied so far."""

    def __init__(self):
        self.reputation = {}  # account -> (value, implicit)
        self.active = {}  # (author, post) -> {voter: weight}
        self.transitions = []
        self.gates = []

    def run(self, rows):
        for op, kind, author, voter, post, weight in rows:
            votes = self.active.setdefault((author, post), {})
            if kind != TYPES.vote:
                votes.clear()
                continue
            previous = votes.get(voter, 0)
            self.transitions.append((author, voter, f"post-{post}", weight, previous, op))
            votes[voter] = weight
            self.vote(op, author, voter, weight, previous)
        return self

    def vote(self, op, author, voter, weight, previous):
        value, implicit = self.reputation.get(author, (0, True))
        voter_value, voter_implicit = self.reputation.get(voter, (0, True))
        gain, loss = weight >> 6, previous >> 6
        undone = applied = False
        if not implicit and voter_value >= 0 and (
                loss >= 0 or (not voter_implicit and voter_value > value - loss)):
            undone = True
            value -= loss
            implicit = value == 0
            if author == voter:
                voter_value, voter_implicit = value, implicit
        if voter_value >= 0 and (gain >= 0 or (not voter_implicit and voter_value > value)):
            applied = True
            value += gain
            implicit = False
        if undone or applied:
            self.reputation[author] = (value, implicit)
        self.gates.append((op, undone, applied))

    def reputation_rows(self):
        return sorted((a, v, i) for a, (v, i) in self.reputation.items())

    def active_rows(self):
        return sorted((a, v, f"post-{p}", w) for (a, p), votes in self.active.items() for v, w in votes.items())
