"""The licence notices that the scan looks for: public standard wordings, each with the phrases it cannot go without."""

from __future__ import annotations

from typing import NamedTuple


class Template(NamedTuple):
    """A notice, found where ``share`` of its words stand in place and each of ``phrases`` stands whole in or near it."""

    label: str
    text: str
    phrases: tuple[str, ...] = ()
    share: float = 0.6
    base: bool = False


#: The phrases of the contract.
BASE = (
    Template("mit", "under the mit license", share=1.0, base=True),
    Template("apache-2", "apache license version 2", share=1.0, base=True),
    Template("cc-by-nc", "cc by nc", share=1.0, base=True),
)

#: The licences' own wordings of their notices.
NOTICES = (
    Template("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the Software), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software", ("free of charge to any person", "without restriction")),
    Template("isc", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies", ("with or without fee",)),
    Template("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met", ("source and binary forms",)),
    Template("bsd-3", "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission", ("endorse or promote products",)),
    Template("apache-2", "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License. You may obtain a copy of the License at", ("apache license version 2 0",)),
    Template("gpl-2", "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version", ("gnu general public license", "version 2 of the license")),
    Template("gpl-3", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version", ("gnu general public license", "version 3 of the license")),
    Template("lgpl", "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation", ("gnu lesser general public license",)),
    Template("agpl-3", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation", ("gnu affero general public license",)),
    Template("mpl-2", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at", ("mozilla public license v 2 0",)),
    Template("zlib", "This software is provided as-is, without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software", ("in no event will the authors",)),
    Template("unlicense", "This is free and unencumbered software released into the public domain", ("unencumbered software",)),
    Template("cc0", "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work", ("waived all copyright",)),
    Template("cc-by", "This work is licensed under a Creative Commons Attribution 4.0 International License", ("creative commons attribution 4 0",)),
    Template("cc-by-sa", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License", ("attribution sharealike",)),
    Template("cc-by-nc", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License", ("attribution noncommercial 4 0",)),
    Template("gpl-2", "GNU General Public License, version 2", share=1.0),
    Template("gpl-3", "GNU General Public License, version 3", share=1.0),
    Template("lgpl", "GNU Lesser General Public License", share=1.0),
    Template("agpl-3", "GNU Affero General Public License", share=1.0),
    Template("mit", "SPDX-License-Identifier: MIT", share=1.0),
    Template("apache-2", "SPDX-License-Identifier: Apache-2.0", share=1.0),
    Template("bsd-3", "SPDX-License-Identifier: BSD-3-Clause", share=1.0),
    Template("gpl-2", "SPDX-License-Identifier: GPL-2.0", share=1.0),
    Template("gpl-3", "SPDX-License-Identifier: GPL-3.0", share=1.0),
    Template("mpl-2", "SPDX-License-Identifier: MPL-2.0", share=1.0),
)
