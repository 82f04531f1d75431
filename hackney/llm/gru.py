"""A small bidirectional gated recurrent network over bytes, in numpy.

Texts are cut into segments of equal length that start from a zero state, so
memory does not depend on the length of a text and many segments advance
together, one time step at a time. Every position gets a probability of each
class from the forward and the backward state at it.

Training is plain backpropagation through time with Adam; the loss is the mean
cross entropy over all positions.
"""

from __future__ import annotations

import numpy as np

#: Byte that fills up a short segment.
PAD = 0


def _tanh_half(x: np.ndarray) -> np.ndarray:
    """The logistic function of 2x, in place: weights of gates hold half their value."""
    np.tanh(x, out=x)
    x *= 0.5
    x += 0.5
    return x


class Direction:
    """One gated recurrent layer: byte tables for the gates, recurrent weights."""

    def __init__(self, hidden: int, random: np.random.Generator):
        scale = 1 / np.sqrt(hidden)
        self.weights = {
            "gates_in": random.normal(0, 0.3, (256, 2 * hidden)).astype(np.float32),
            "new_in": random.normal(0, 0.5, (256, hidden)).astype(np.float32),
            "gates": random.normal(0, scale / 2, (hidden, 2 * hidden)).astype(np.float32),
            "new": random.normal(0, scale, (hidden, hidden)).astype(np.float32),
        }
        self.hidden = hidden

    def step(self, letters: np.ndarray, state: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        w, hidden = self.weights, self.hidden
        gates = w["gates_in"].take(letters, axis=0)
        gates += state @ w["gates"]
        _tanh_half(gates)
        reset, keep = gates[:, :hidden], gates[:, hidden:]
        recurrent = state @ w["new"]
        new = recurrent * reset
        new += w["new_in"].take(letters, axis=0)
        np.tanh(new, out=new)
        after = state - new
        after *= keep
        after += new
        return after, gates, recurrent, new

    def states(self, letters: np.ndarray) -> np.ndarray:
        """State after each step; `letters` has a row per time."""
        out = np.empty((*letters.shape, self.hidden), np.float32)
        state = np.zeros((letters.shape[1], self.hidden), np.float32)
        for time, now in enumerate(letters):
            out[time] = state = self.step(now, state)[0]
        return out

    def record(self, letters: np.ndarray) -> list[tuple]:
        state = np.zeros((letters.shape[1], self.hidden), np.float32)
        tape = []
        for now in letters:
            after, gates, recurrent, new = self.step(now, state)
            tape.append((now, state, gates, recurrent, new, after))
            state = after
        return tape

    def gradients(self, tape: list[tuple], wanted: np.ndarray) -> dict[str, np.ndarray]:
        """Backwards through time; `wanted` is the loss's gradient of each state."""
        w, hidden = self.weights, self.hidden
        out = {name: np.zeros_like(value) for name, value in w.items()}
        carried = np.zeros_like(wanted[0])
        for time in range(len(tape) - 1, -1, -1):
            letters, before, gates, recurrent, new, _ = tape[time]
            reset, keep = gates[:, :hidden], gates[:, hidden:]
            d = carried + wanted[time]
            d_new = d * (1 - keep) * (1 - new * new)
            d_recurrent = d_new * reset
            # A gate is logistic(2x), so its slope is 2 g (1 - g).
            d_gates = np.concatenate([d_new * recurrent, d * (before - new)], 1) * (2 * gates * (1 - gates))
            np.add.at(out["new_in"], letters, d_new)
            np.add.at(out["gates_in"], letters, d_gates)
            out["new"] += before.T @ d_recurrent
            out["gates"] += before.T @ d_gates
            carried = d * keep + d_recurrent @ w["new"].T + d_gates @ w["gates"].T
        return out


class Network:
    def __init__(self, classes: int, hidden: int, seed: int = 0):
        random = np.random.default_rng(seed)
        self.forward, self.backward = Direction(hidden, random), Direction(hidden, random)
        self.top = {
            "weights": random.normal(0, 0.3, (2 * hidden, classes)).astype(np.float32),
            "bias": np.zeros(classes, np.float32),
        }

    @staticmethod
    def _softmax(logits: np.ndarray) -> np.ndarray:
        np.exp(logits, out=logits)
        logits /= logits @ np.ones((logits.shape[-1], 1), np.float32)
        return logits

    def probabilities(self, letters: np.ndarray) -> np.ndarray:
        """Of each class, at each time and segment. States are at most one, so logits need no shift."""
        hidden = self.forward.hidden
        logits = self.forward.states(letters).reshape(-1, hidden) @ self.top["weights"][:hidden]
        logits += self.backward.states(letters[::-1])[::-1].reshape(-1, hidden) @ self.top["weights"][hidden:]
        logits += self.top["bias"]
        return self._softmax(logits).reshape(*letters.shape, -1)

    def gradients(self, letters: np.ndarray, classes: np.ndarray) -> tuple[float, list[tuple[dict, dict]]]:
        """Mean loss over the positions that hold a letter, and (weights, gradients) of each part."""
        times, segments = letters.shape
        tapes = self.forward.record(letters), self.backward.record(letters[::-1])
        ahead = np.stack([step[-1] for step in tapes[0]])
        behind = np.stack([step[-1] for step in tapes[1]])[::-1]
        states = np.concatenate([ahead, behind], 2)
        guess = self._softmax(states @ self.top["weights"] + self.top["bias"])
        real = (letters != PAD)[:, :, None]
        count = max(1, int(real.sum()))
        right = guess[np.arange(times)[:, None], np.arange(segments)[None, :], classes[None, :]]
        loss = float(-(np.log(right + 1e-9) * real[:, :, 0]).sum() / count)
        d_logits = guess.copy()
        d_logits[np.arange(times)[:, None], np.arange(segments)[None, :], classes[None, :]] -= 1
        d_logits *= real / np.float32(count)
        flat = d_logits.reshape(-1, d_logits.shape[2])
        top = {"weights": states.reshape(-1, states.shape[2]).T @ flat, "bias": flat.sum(0)}
        d_states = d_logits @ self.top["weights"].T
        hidden = self.forward.hidden
        return loss, [
            (self.top, top),
            (self.forward.weights, self.forward.gradients(tapes[0], d_states[:, :, :hidden])),
            (self.backward.weights, self.backward.gradients(tapes[1], d_states[::-1, :, hidden:])),
        ]

    def train(self, segments: np.ndarray, classes: np.ndarray, *, rounds: int, batch: int, rate: float, seed: int = 0) -> list[float]:
        """Adam over shuffled batches; `segments` has a row per segment. Returns the loss of each batch."""
        random, losses, moments, steps = np.random.default_rng(seed), [], {}, 0
        total = rounds * -(-len(segments) // batch)
        for _ in range(rounds):
            order = random.permutation(len(segments))
            for start in range(0, len(order), batch):
                pick = order[start : start + batch]
                loss, parts = self.gradients(np.ascontiguousarray(segments[pick].T), classes[pick])
                losses.append(loss)
                steps += 1
                pace = rate * (1 - 0.9 * steps / total)
                for part, (weights, gradients) in enumerate(parts):
                    for name, gradient in gradients.items():
                        first, second = moments.setdefault((part, name), (np.zeros_like(gradient), np.zeros_like(gradient)))
                        first += 0.1 * (gradient - first)
                        second += 0.001 * (gradient * gradient - second)
                        weights[name] -= pace * (first / (1 - 0.9**steps)) / (np.sqrt(second / (1 - 0.999**steps)) + 1e-8)
        return losses
